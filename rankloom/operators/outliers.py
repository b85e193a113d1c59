"""Is anything near? Density, distance and conformal thresholds for the gate, temperature, and transport between sets of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import dense, metrics


def density(corpus: DataFrame, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(query_id, density): the mean cosine with the ``k`` nearest documents."""
    return dense.topk(corpus, queries, k, skip_self=skip_self).groupBy("query_id").agg(F.avg("score").alias("density"))


def mahalanobis(corpus: DataFrame, queries: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(query_id, distance) of each query from the corpus' mean in its covariance, ``ridge`` added to the variances.

    A task gives back its count, sum and sum of products; what meets on the driver are dim x dim numbers a task.
    """
    rows = corpus.select(F.col("vector").cast("array<double>").alias("vector")).where(dense.valid(F.col("vector")))
    first = queries.select(F.size("vector")).first()
    dim = first[0] if first else 0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = dense._matrix(batch.column(0))
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])

    n, s, ss = 0, np.zeros(dim), np.zeros(dim * dim)
    for r in rows.where(F.size("vector") == dim).mapInArrow(partial, "n long, s array<double>, ss array<double>").toLocalIterator():
        n, s, ss = n + r["n"], s + np.array(r["s"]), ss + np.array(r["ss"])
    mean = s / max(n, 1)
    inverse = np.linalg.inv(ss.reshape(dim, dim) / max(n, 1) - np.outer(mean, mean) + ridge * np.eye(dim)) if dim else np.zeros((0, 0))
    kind = dict(queries.dtypes)["query_id"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = dense._matrix(batch.column(1)) - mean
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0)))], names=["query_id", "distance"])

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(dense.valid(F.col("vector")) & (F.size("vector") == dim))
    return asked.mapInArrow(measure, f"query_id {kind}, distance double")


def conformal(observed: DataFrame, risk: float) -> DataFrame:
    """One row: the threshold under which a right match's confidence falls with a chance of ``risk`` at most, from (confidence, correct) of a calibration set.

    It is the order statistic at floor(risk * (n + 1)) of the right ones' confidences, ascending; null where that is none,
    and then nothing may be withheld.
    """
    right = observed.where((F.col("correct") == 1) & F.col("confidence").isNotNull()).groupBy("confidence").agg(F.count(F.lit(1)).alias("c"))
    upto = metrics.running(right, "confidence", ["c"])
    n = right.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    place = F.floor(F.lit(risk) * (F.col("n") + 1))
    return n.crossJoin(F.broadcast(upto.crossJoin(F.broadcast(n)).agg(F.min(F.when((F.col("upto_c") >= place) & (place >= 1), F.col("confidence"))).alias("threshold")))).select("threshold", "n")


def temperature(observed: DataFrame, steps: int = 61) -> DataFrame:
    """One row: the temperature from 0.1 to 10, evenly spaced in logarithm, with the least mean loss of 1 / (1 + exp(-confidence / t)) against ``correct``; one pass."""
    grid = [10 ** (-1 + 2 * i / (steps - 1)) for i in range(steps)]
    # ln(1 + exp(-z)) without overflow
    loss = lambda z: F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    signed = F.when(F.col("correct") == 1, F.col("confidence")).otherwise(-F.col("confidence"))
    row = observed.agg(*[F.avg(loss(signed / t)).alias(f"l{i}") for i, t in enumerate(grid)])
    best = F.array_min(F.array(*[F.struct(F.round(f"l{i}", 12).alias("loss"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)]))
    return row.select(best["temperature"].alias("temperature"), best["loss"].alias("loss"))


def transport_cost(x: np.ndarray, y: np.ndarray, strength: float = 20.0, rounds: int = 200) -> float:
    """The cost of moving equal masses on ``x`` to equal masses on ``y`` at one minus cosine, by Sinkhorn's scaling."""
    cost = 1 - dense._unit(x) @ dense._unit(y).T
    kernel = np.exp(-strength * cost)
    a, b = np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y))
    v = np.ones(len(y))
    for _ in range(rounds):
        u = a / (kernel @ v)
        v = b / (kernel.T @ u)
    return float((u[:, None] * kernel * v[None, :] * cost).sum())


def transport(pairs: DataFrame, strength: float = 20.0, rounds: int = 200) -> DataFrame:
    """(query_id, doc_id, cost) of candidate pairs (query_id, doc_id, xs, ys), two lists of vectors; null where a list is empty."""
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [transport_cost(np.array(x), np.array(y), strength, rounds) if x and y else None for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.float64())], names=["query_id", "doc_id", "cost"])

    return pairs.select("query_id", "doc_id", "xs", "ys").mapInArrow(run, f"query_id {types['query_id']}, doc_id {types['doc_id']}, cost double")
