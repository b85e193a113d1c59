"""Ranking and confidence over (query_id, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Scores that agree to so many places are ties, and ties go to the smaller id.
RAW_PLACES, UNIT_PLACES = 6, 9


def ranked(scores: DataFrame, k: int | None = None, places: int = UNIT_PLACES) -> DataFrame:
    """``scores`` with rank from 1; the best ``k`` of each query, or all."""
    if k is not None and k < 1:
        raise ValueError("k must be 1 or more")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", places)), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def padded(top: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``top`` (query_id, doc_id, score, rank; the ``k`` best that have a score) filled up to ``k`` rows a query by documents without one, in order of their ids.

    The first ``k`` ids hold enough of them: at most as many of these as a query has rows are taken.
    """
    first = corpus.select("doc_id").orderBy("doc_id").limit(k)  # k rows, a stated number
    spare = queries.select("query_id").crossJoin(F.broadcast(first)).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    have = top.select("query_id", "doc_id", "score", F.lit(0).alias("pad")).unionByName(spare.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("pad")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", UNIT_PLACES)), "doc_id")
    return have.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def confidence(scores: DataFrame, n: DataFrame | int) -> DataFrame:
    """(query_id, confidence): how many population deviations the best of all ``n`` scores (a number, or one row with ``n``) lies above their mean.

    Documents without a row count as zeros: their part of mean and deviation follows from how many there are.
    """
    return confidence_of(moments(scores), n)


def moments(scores: DataFrame) -> DataFrame:
    """(query_id, c, m, v, top): number, mean, variance and largest of a query's scores."""
    return scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.avg("score").alias("m"), F.var_pop("score").alias("v"), F.max("score").alias("top"))


def confidence_of(own: DataFrame, n: DataFrame | int) -> DataFrame:
    """``confidence`` from ``moments``."""
    own = own.crossJoin(F.broadcast(n.select(F.col("n").cast("double")))) if isinstance(n, DataFrame) else own.withColumn("n", F.lit(float(n)))
    own = own.withColumn("mean", F.col("m") * F.col("c") / F.col("n"))
    spread = F.col("c") * (F.col("v") + (F.col("m") - F.col("mean")) ** 2) + (F.col("n") - F.col("c")) * F.col("mean") ** 2
    own = own.withColumn("std", F.sqrt(spread / F.col("n"))).withColumn("best", F.when(F.col("c") < F.col("n"), F.greatest("top", F.lit(0.0))).otherwise(F.col("top")))
    return own.select("query_id", F.when(F.col("std") <= 1e-9, 0.0).otherwise((F.col("best") - F.col("mean")) / F.col("std")).alias("confidence"))


def margin(scores: DataFrame, places: int = UNIT_PLACES) -> DataFrame:
    """(query_id, margin): best score less the second best, 0 where there's no second."""
    two = ranked(scores, 2, places)
    return two.groupBy("query_id").agg((F.max("score") - F.min("score")).alias("margin"))


def entropy(scores: DataFrame) -> DataFrame:
    """(query_id, entropy) of the softmax over a query's scores."""
    top = scores.groupBy("query_id").agg(F.max("score").alias("top"))
    e = scores.join(top, "query_id").withColumn("e", F.exp(F.col("score") - F.col("top"))).withColumn("s", F.col("score") - F.col("top"))
    return e.groupBy("query_id").agg((F.ln(F.sum("e")) - F.sum(F.col("e") * F.col("s")) / F.sum("e")).alias("entropy"))


def fused(members: list[DataFrame], k: int, pool: int | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of score relations: (query_id, doc_id, rrf, score, rank); score is the best member score, 0 at least.

    Ties go to what the first member ranks, in its order, then to the second's, and so on.
    """
    pool = pool or max(5 * k, 50)
    lists = None
    for m, scores in enumerate(members):
        part = (scores if "rank" in scores.columns else ranked(scores, pool)).where(F.col("rank") <= pool).select("query_id", "doc_id", "score", "rank", F.lit(m).alias("member"))
        lists = part if lists is None else lists.unionByName(part)
    met = lists.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.min(F.struct("member", "rank")).alias("met"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", UNIT_PLACES)), "met", "doc_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "rrf", "score", "rank")


def best_signal(signals: list[DataFrame]) -> DataFrame:
    """(query_id, confidence): the largest of the members' confidences, 0 where none has one."""
    every = signals[0]
    for s in signals[1:]:
        every = every.unionByName(s)
    return every.groupBy("query_id").agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"))


def committee(members: list[DataFrame], pool: int) -> DataFrame:
    """(query_id, doc_id, votes, mean_score): first places, and the mean over all members of the scores in their pools, 0 where a member has none."""
    lists = None
    for scores in members:
        part = ranked(scores, pool).select("query_id", "doc_id", "score", "rank")
        lists = part if lists is None else lists.unionByName(part)
    return lists.groupBy("query_id", "doc_id").agg(F.count_if(F.col("rank") == 1).alias("votes"), (F.sum("score") / len(members)).alias("mean_score"))


def borda(members: list[DataFrame], pool: int) -> DataFrame:
    """(query_id, doc_id, points): the sum over members of pool - rank, for the best ``pool`` of each."""
    lists = None
    for scores in members:
        part = ranked(scores, pool).select("query_id", "doc_id", "rank")
        lists = part if lists is None else lists.unionByName(part)
    return lists.groupBy("query_id", "doc_id").agg(F.sum(F.lit(pool) - F.col("rank")).alias("points"))
