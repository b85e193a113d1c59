"""Sources and sinks: described documents, catalogs, outlines, code-point lists, JSON lists, images, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rankloom.functions import text as tx

LISTS = ("visual_concepts", "task_intents", "example_tasks", "poor_matches")
DESCRIPTION = T.StructType(
    [T.StructField("icon_usefulness", T.DoubleType()), T.StructField("discard", T.BooleanType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in LISTS] + [T.StructField("reasoning", T.StringType())]
)


def clean_list(column: Column) -> Column:
    """Entries that aren't blank, as they are; null gives an empty list."""
    return F.coalesce(F.filter(column, lambda x: x.isNotNull() & (tx.strip(x) != "")), F.array().cast("array<string>"))


def descriptions(spark: SparkSession, folder: str, keep_discarded: bool = False, tolerant: bool = False) -> DataFrame:
    """(name, prior, lists, reasoning) of a folder of JSON files, one document each; the name is the file's.

    ``tolerant`` reads each file as a variant, so that a scalar where a list should be is a list of one.
    """
    files = spark.read.option("multiLine", True)
    if tolerant:
        v = files.option("singleVariantColumn", "v").json(folder).select("v", "_metadata.file_name")
        get = lambda c, t: F.try_variant_get("v", f"$.{c}", t)
        raw = v.select(
            "file_name", get("icon_usefulness", "double").alias("icon_usefulness"), get("discard", "boolean").alias("discard"),
            *[F.coalesce(get(c, "array<string>"), F.when(get(c, "string").isNotNull(), F.array(get(c, "string")))).alias(c) for c in LISTS], get("reasoning", "string").alias("reasoning"))
    else:
        raw = files.schema(DESCRIPTION).json(folder).select("*", "_metadata.file_name")
    kept = raw if keep_discarded else raw.where(~F.coalesce("discard", F.lit(False)))
    return kept.select(
        F.regexp_replace("file_name", r"\.json$", "").alias("name"), (F.coalesce("icon_usefulness", F.lit(0.0)) / 10.0).alias("prior"),
        *[clean_list(F.col(c)).alias(c) for c in LISTS], F.coalesce("reasoning", F.lit("")).alias("reasoning"))


def with_catalog(docs: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """``docs`` with char and popularity of an optional catalog; defaults where it has no entry, the last of repeated ones."""
    if catalog is None:
        return docs.withColumns({"char": F.lit(""), "popularity": F.lit(0)})
    last = Window.partitionBy("name").orderBy(F.desc("place"))
    one = catalog.withColumn("place", F.monotonically_increasing_id()).withColumn("r", F.row_number().over(last)).where("r = 1").select("name", "char", "popularity")
    return docs.join(one, "name", "left").withColumns({"char": F.coalesce("char", F.lit("")), "popularity": F.coalesce(F.col("popularity").cast("int"), F.lit(0))})


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, codepoint string, char string, tags array<string>, categories array<string>, popularity int").option("multiLine", True).json(path)


def field_text(column: Column) -> Column:
    return F.array_join(column, ", ")


def document(include_examples: bool = True) -> Column:
    """The concatenated text of a described document."""
    fields = [field_text(F.col("visual_concepts")), field_text(F.col("task_intents"))] + [field_text(F.col("example_tasks"))] * include_examples + [F.col("reasoning")]
    return F.concat_ws(". ", *[F.nullif(f, F.lit("")) for f in fields])


def outline_tasks(spark: SparkSession, folder: str, suffix: str = "org") -> DataFrame:
    """(file, line, title, tags, text) of the task headings in a folder of outlines, recursively."""
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{suffix}").select("value", F.col("_metadata.file_path").alias("file"))
    lines = whole.select("file", F.posexplode(F.split("value", "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")).alias("line", "raw"))
    return tasks(lines)


def tasks(lines: DataFrame) -> DataFrame:
    """Task headings among (file, line, raw)."""
    parsed = lines.select("file", "line", tx.heading(F.col("raw")).alias("h")).where("h is not null")
    return parsed.select("file", "line", "h.title", "h.tags", "h.text")


def write_tasks(tasks: DataFrame, path: str) -> None:
    """JSON lines of file, title, tags and text."""
    tasks.select("file", "title", "tags", "text").write.json(path)


def codepoints(spark: SparkSession, path: str) -> DataFrame:
    """(name, codepoint, char) of lines with exactly two words, the second hexadecimal."""
    words = spark.read.text(path).select(F.split(tx.strip(F.col("value")), rf"(?U){tx.WS}+").alias("w")).where((F.size("w") == 2) & F.col("w")[1].rlike("^[0-9a-fA-F]{1,6}$"))
    return words.select(F.col("w")[0].alias("name"), F.conv(F.col("w")[1], 16, 10).cast("int").alias("codepoint"), tx.codepoint_char(F.col("w")[1]).alias("char"))


METADATA = "array<struct<name:string,tags:array<string>,categories:array<string>,popularity:int>>"


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(name, tags, categories, popularity) of a JSON answer {"icons": [...]} in which anything may stand before the first brace; the last of repeated names."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)(\{.*)", 1).alias("j"))
    rows = whole.select(F.posexplode(F.from_json("j", f"icons {METADATA}")["icons"]).alias("place", "m")).select("place", "m.*")
    return rows.groupBy("name").agg(F.max_by(F.struct("tags", "categories", "popularity"), "place").alias("m")).select("name", "m.*")


def build_catalog(points: DataFrame, described: DataFrame) -> DataFrame:
    """(name, codepoint, char, tags, categories, popularity): every code point, with what is known of it; hexadecimal of four places at least."""
    known = points.dropDuplicates(["name"]).join(described, "name", "left")
    none = F.array().cast("array<string>")
    return known.select(
        "name", F.lower(F.format_string("%04x", "codepoint")).alias("codepoint"), "char",
        F.coalesce("tags", none).alias("tags"), F.coalesce("categories", none).alias("categories"), F.coalesce("popularity", F.lit(0)).alias("popularity"))


def untagged(catalog_rows: DataFrame) -> DataFrame:
    """One row: symbols, and those without tags."""
    return catalog_rows.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.size("tags") == 0).alias("untagged"))


def write_catalog(catalog_rows: DataFrame, path: str) -> None:
    """JSON lines by name."""
    catalog_rows.orderBy("name").write.json(path)


def json_list(spark: SparkSession, text: str) -> DataFrame:
    """(query_id, text) of a JSON list of strings; anything else is an error."""
    row = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "array<string>").alias("a"))
    if not text.lstrip().startswith("[") or row.first()["a"] is None:
        raise ValueError("expected a JSON list of strings")
    return row.select(F.posexplode("a").alias("query_id", "text")).withColumn("query_id", F.col("query_id").cast("long"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the PNG files with plain names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"), "content").where(F.col("name").rlike("^[A-Za-z0-9_.-]+$"))


def write_decisions(decisions: DataFrame, path: str) -> None:
    """JSON lines of task and shown document; of repeated tasks, the decision of the last query counts."""
    last = decisions.groupBy("text").agg(F.max_by(F.struct(F.when(F.col("shown"), F.col("doc_id")).alias("doc_id")), "query_id").alias("d"))
    last.select("text", "d.doc_id").write.json(path)


def write_results(metrics: DataFrame, path: str, **config: str) -> None:
    """Metrics rows with configuration and time, as JSON."""
    metrics.withColumns({f"config_{k}": F.lit(v) for k, v in config.items()}).withColumn("written_at", F.current_timestamp()).write.json(path)


def missing_outputs(wanted: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(key), key, "left_anti")


def invalid_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problems) of files that lack a required field or hold a wrong type: a whole number or boolean, a boolean, lists; reasoning may be anything."""
    v = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(folder).select("v", "_metadata.file_name")
    kinds = {"icon_usefulness": "^(BIGINT|BOOLEAN)$", "discard": "^BOOLEAN$", **dict.fromkeys(LISTS, "^ARRAY"), "reasoning": "."}
    of = lambda c: F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant"))
    bad = F.array_compact(F.array(*[F.when(F.coalesce(~of(c).rlike(k), F.lit(True)), F.lit(c)) for c, k in kinds.items()]))
    return v.select(F.regexp_replace("file_name", r"\.json$", "").alias("name"), bad.alias("problems")).where(F.size("problems") > 0)
