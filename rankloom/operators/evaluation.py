"""Evaluation sets: held-out examples as queries, poor matches as negatives; and whole evaluations of a method of ``rankloom.methods``."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import metrics

# fixed values
GIBBERISH = ("asdfqwer zxcv", "blorp glarn fizzbuzzle", "qwertyuiop", "zzxxcc vvbb nnmm", "lorem ipsum dolor sit", "xyzzy plugh frobnicate")
MULTILINGUAL = ("Caminar 8000 pasos al día", "Reservar cita con el dentista", "Купить продукты в магазине", "Прочитать главу книги")

def eligible(corpus: DataFrame, min_prior: float) -> DataFrame:
    return corpus.where((F.col("prior") >= min_prior) & (F.size("example_tasks") >= 2))


def build(corpus: DataFrame, sample: int, min_prior: float = 0.6, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(positives(query_id, text, doc_id), negatives(query_id, text, bad_doc_id)): one example and one poor match of each sampled row.

    The sample is the first rows by md5 of seed and id, and the choice within a list follows the same hash: repeatable
    anywhere. Its size is the feature.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    number = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    chosen = eligible(corpus, min_prior).withColumn("key", key).orderBy("key", "doc_id").limit(sample)
    pick = lambda c: F.element_at(c, (F.pmod(number, F.size(c)) + 1).cast("int"))
    positives = chosen.select(F.col("doc_id").alias("query_id"), pick("example_tasks").alias("text"), "doc_id")
    poor = chosen.where(F.size("poor_matches") > 0).select(F.col("doc_id").alias("query_id"), pick("poor_matches").alias("text"), F.col("doc_id").alias("bad_doc_id"))
    return positives, poor


def without_held_out(examples: DataFrame, held_out: DataFrame) -> DataFrame:
    """Examples whose exact text isn't among the held-out ones, whoever owns them."""
    return examples.join(held_out.select("text").distinct(), "text", "left_anti")


def leak_free(keys: tuple[str, ...], corpus: DataFrame, positives: DataFrame, **options) -> dict[str, object]:
    """The methods of ``keys`` with no way to the answers: examples are left out of documents, and queries out of the examples of M2."""
    from rankloom import methods

    return {k: methods.build(k, corpus, include_examples=False, held_out=positives, **options) for k in keys}


def silly(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"g{i}", t) for i, t in enumerate(GIBBERISH)], "query_id string, text string")


def judged(method, positives: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, confidence, correct): where the gold document of each query is ranked, null beyond ``k``, and whether it is the best."""
    asked = positives.select("query_id", "text")
    found = method.pool(asked, k)
    ranks = metrics.gold_ranks(positives.select("query_id", "doc_id"), found.top)
    return _correct(ranks.join(found.confidence, "query_id", "left"))


def _correct(ranks: DataFrame) -> DataFrame:
    return ranks.select("query_id", "rank", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0)).alias("correct"))


def evaluate(method, positives: DataFrame, poor: DataFrame, k: int = 10, coverages: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """One row of metrics of a method: ranking, the gate's AUROC, suppression of poor matches, precision at coverage, number of queries.

    All queries are asked at once. For the AUROC a query counts as 1 if its best match is the gold document; wrong ones
    count as 0, as gibberish does. What is kept of the answers is ``k`` rows a query, and the metrics are one row.
    """
    spark = positives.sparkSession
    tagged = lambda kind, rows: rows.withColumn("query_id", F.concat(F.lit(kind), F.col("query_id").cast("string")))
    gold, bad, nonsense = tagged("p", positives), tagged("n", poor), silly(spark)
    asked = gold.select("query_id", "text").unionByName(bad.select("query_id", "text")).unionByName(nonsense)
    found = method.pool(asked, k)
    top, sure = found.top.persist(), asked.select("query_id").join(found.confidence, "query_id", "left").select("query_id", F.round(F.coalesce("confidence", F.lit(0.0)), 9).alias("confidence")).persist()
    seen = _correct(metrics.gold_ranks(gold.select("query_id", "doc_id"), top).join(sure, "query_id", "left")).persist()
    unsure = nonsense.select("query_id").join(sure, "query_id").select(F.col("confidence").alias("score"), F.lit(0).alias("label"))
    row = metrics.rank_metrics(seen, k).first().asDict()
    row["gate_auroc"] = metrics.auroc(seen.select(F.col("confidence").alias("score"), F.col("correct").alias("label")).unionByName(unsure)).first()["auroc"]
    row["poor_match_suppression"] = metrics.suppression(bad.select("query_id", "bad_doc_id"), top.where("rank = 1")).first()["suppression"]
    at = {r["coverage"]: r["precision"] for r in metrics.precision_at_coverage(seen, coverages).collect()}
    row |= {f"precision_at_{round(100 * c)}": at.get(c) for c in coverages}
    for held in (top, sure, seen):
        held.unpersist()
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'long' if n == 'n_queries' else 'double'}" for n in row))


def report(methods_by_key: dict[str, object], positives: DataFrame, poor: DataFrame, k: int = 10) -> DataFrame:
    """A row of ``evaluate`` for each method; they run side by side, since most of their many small jobs leave cores idle."""
    one = inheritable_thread_target(lambda item: evaluate(item[1], positives, poor, k).withColumn("method", F.lit(item[0])))
    with ThreadPoolExecutor(max(1, len(methods_by_key))) as pool:
        rows = list(pool.map(one, methods_by_key.items()))
    return reduce(DataFrame.unionByName, rows)


def latencies(method, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ms): how long each query takes on its own. Measures; for results, ask all queries at once."""
    took = []
    for r in queries.select("query_id", "text").toLocalIterator():
        one = queries.sparkSession.createDataFrame([r], queries.select("query_id", "text").schema)
        began = time.perf_counter()
        method.pool(one, k).top.collect()
        took.append((r["query_id"], 1000 * (time.perf_counter() - began)))
    kind = dict(queries.dtypes)["query_id"]
    return queries.sparkSession.createDataFrame(took, f"query_id {kind}, ms double")


def smoke(method, spark: SparkSession, k: int = 3) -> DataFrame:
    """(query_id, text, doc_id, score, rank): the best matches of a few queries in other languages, to look at."""
    asked = spark.createDataFrame(list(enumerate(MULTILINGUAL)), "query_id long, text string")
    return method.pool(asked, k).top.join(asked, "query_id").select("query_id", "text", "doc_id", F.bround("score", 3).alias("score"), "rank")
