"""What to label next, and how to split what is labelled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import dense, rank


def _number(seed: int, key: Column) -> Column:
    """A number from 0 to 2**32 - 1 that follows from seed and key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def folds(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``fold`` from 0 to n - 1, in each stratum in even shares: a hash deals the rows, so no stratum meets in one task."""
    return rows.withColumn("fold", F.pmod(_number(seed, F.concat_ws("\0", F.col(stratum).cast("string"), F.col(key).cast("string"))), F.lit(n)).cast("int"))


def per_split(observed: DataFrame, split: str, value: str) -> DataFrame:
    """(split, n, mean, deviation) of a metric's per-query values in each split."""
    return observed.groupBy(split).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def uncertain(observed: DataFrame, n: int) -> DataFrame:
    """The ``n`` queries of least confidence, ties by id."""
    return observed.orderBy(F.round("confidence", rank.UNIT_PLACES), "query_id").limit(n)


def disputed(members: list[DataFrame], n: int) -> DataFrame:
    """(query_id, choices, entropy): the ``n`` queries on whose best document the members (query_id, doc_id, score) agree least."""
    votes = None
    for m, scores in enumerate(members):
        part = rank.ranked(scores, 1).select("query_id", "doc_id", F.lit(m).alias("member"))
        votes = part if votes is None else votes.unionByName(part)
    each = votes.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = each.groupBy("query_id").agg(F.count(F.lit(1)).alias("choices"), F.sum("c").alias("t"), F.sum(F.col("c") * F.ln("c")).alias("cl"))
    out = total.select("query_id", "choices", (F.ln("t") - F.col("cl") / F.col("t")).alias("entropy"))
    return out.orderBy(F.desc(F.round("entropy", rank.UNIT_PLACES)), "query_id").limit(n)


def diverse(found: DataFrame, corpus: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """(query_id, doc_id, score, rank): of each query's pool ``found`` (query_id, doc_id, score), ``k`` by maximal marginal relevance.

    Each next one has the largest ``balance`` times its score less (1 - balance) times its closest cosine with those already
    chosen, ties by id. A pool is a top list, so it is of a stated size.
    """
    types = dict(found.dtypes)
    rows = found.select("query_id", "doc_id", "score").join(corpus.select("doc_id", F.col("vector").cast("array<double>").alias("vector")), "doc_id").where(dense.valid(F.col("vector")))

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("doc_id", kind="stable").reset_index(drop=True)
        unit = dense._unit(np.array(pool["vector"].tolist(), np.float64))
        close = np.full(len(pool), -np.inf)
        left, chosen = np.ones(len(pool), bool), []
        while left.any() and len(chosen) < k:
            gain = balance * pool["score"].to_numpy() - (1 - balance) * np.where(np.isinf(close), 0.0, close)
            best = int(np.argmax(np.where(left, np.round(gain, rank.UNIT_PLACES), -np.inf)))
            chosen.append(best)
            left[best] = False
            close = np.maximum(close, unit @ unit[best])
        out = pool.iloc[chosen][["query_id", "doc_id", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double, rank int")


def core_set(corpus: DataFrame, k: int) -> DataFrame:
    """(doc_id, rank, distance): ``k`` rows that cover the corpus, each next one the farthest in cosine from those chosen; the first has the smallest id.

    ``k`` passes over the corpus, which is never collected: a pass brings one row.
    """
    rows = corpus.select("doc_id", F.col("vector").cast("array<double>").alias("vector")).where(dense.valid(F.col("vector"))).persist()
    first = rows.orderBy("doc_id").first()
    if first is None:
        return corpus.sparkSession.createDataFrame([], f"doc_id {dict(corpus.dtypes)['doc_id']}, rank int, distance double")
    chosen = [(first["doc_id"], 1, 0.0, first["vector"])]
    while len(chosen) < k:
        centers = corpus.sparkSession.createDataFrame([(i, v) for i, (_, _, _, v) in enumerate(chosen)], "query_id long, vector array<double>")
        near = dense.scores(rows, centers).groupBy("doc_id").agg((1 - F.max("score")).alias("distance"))
        best = near.orderBy(F.desc(F.round("distance", rank.UNIT_PLACES)), "doc_id").first()
        if best is None or round(best["distance"], rank.UNIT_PLACES) <= 0:
            break
        vector = rows.where(F.col("doc_id") == F.lit(best["doc_id"])).first()["vector"]
        chosen.append((best["doc_id"], len(chosen) + 1, best["distance"], vector))
    rows.unpersist()
    return corpus.sparkSession.createDataFrame([c[:3] for c in chosen], f"doc_id {dict(corpus.dtypes)['doc_id']}, rank int, distance double")


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label): labels spread over weighted edges (a, b, weight), both ways; seeds (node, label) keep theirs.

    In each round a node without a seed takes the label with the largest weight among its neighbours, ties by label.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    labels = seeds.select("node", "label")
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.round(F.sum("weight"), rank.UNIT_PLACES).alias("w"))
        taken = votes.groupBy("node").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("label"))
        labels = taken.join(seeds.select("node"), "node", "left_anti").unionByName(seeds.select("node", "label"))
    return labels
