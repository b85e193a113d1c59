"""Encoders of texts, and a cache of vectors keyed by content.

An encoder is a Column expression from text to ``array<double>``. The default counts hashed tokens: deterministic, inside
the JVM, the same in any engine. A trained model is plugged in as an Arrow UDF that loads once a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankloom.functions import text as tx

# fixed values: what models of a family want before a query and before a document; the first that a name contains counts
QUERY_PREFIXES = {"e5": "query: ", "bge": "Represent this sentence for searching relevant passages: "}
DOCUMENT_PREFIXES = {"e5": "passage: "}

HASH_DIM = 64


def prefix(model: str, query: bool) -> str:
    table = QUERY_PREFIXES if query else DOCUMENT_PREFIXES
    return next((p for family, p in table.items() if family in model.lower()), "")


@dataclass(frozen=True)
class Encoder:
    """``name`` tells models apart in caches and names the family; ``encode`` makes vectors of texts."""

    name: str
    encode: Callable[[Column], Column]

    def column(self, text: Column, query: bool) -> Column:
        before = prefix(self.name, query)
        return self.encode(F.concat(F.lit(before), text) if before else text)

    def key(self, text: Column, view: str, query: bool = False) -> Column:
        """What a vector depends on: model, view and the text itself."""
        side = "query" if query else "document"
        return F.sha1(F.concat(F.lit(f"{self.name}\0{view}\0{side}\0"), F.coalesce(text, F.lit(""))).cast("binary"))


def hashing(dim: int = HASH_DIM) -> Encoder:
    """Counts of tokens by md5 bucket."""

    def encode(text: Column) -> Column:
        buckets = F.transform(tx.tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % dim)
        held = lambda b, i: (F.size(b) - F.size(F.array_remove(b, i))).cast("double")
        # the buckets of a text are found once, not once a dimension
        return tx.bind(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: held(b, i)))

    return Encoder(f"hashing-{dim}", encode)


def model(name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Encoder:
    """An encoder around ``load()``, which gives a function of a list of texts; it is called once in each Python worker."""
    loaded: list = []

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(text: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(load())
        return pd.Series([list(map(float, v)) for v in loaded[0](text.fillna("").tolist())], dtype=object)

    return Encoder(name, lambda text: encode(text))


def vectors(rows: DataFrame, encoder: Encoder, text: str = "text", view: str = "document", query: bool = False, cache: str | None = None) -> DataFrame:
    """``rows`` with their ``vector``. With ``cache``, a folder of Parquet files (key, vector), only texts that it lacks are encoded, and added to it.

    The key holds the text, so an edited text gets a vector of its own; texts that repeat are encoded once.
    """
    if cache is None:
        return rows.withColumn("vector", encoder.column(F.coalesce(text, F.lit("")), query))
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", encoder.key(F.col(text), view, query))
    wanted = keyed.select("_key", F.coalesce(text, F.lit("")).alias("_text")).dropDuplicates(["_key"])
    missing = wanted.join(known, "_key", "left_anti") if (known := _cached(spark, cache)) is not None else wanted
    missing.select("_key", encoder.column(F.col("_text"), query).alias("vector")).write.mode("append").parquet(cache)
    # a job that ran twice at once may have written a key twice
    return keyed.join(_cached(spark, cache).dropDuplicates(["_key"]), "_key", "left").drop("_key")


def _cached(spark, cache: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("_key string, vector array<double>").parquet(cache)
