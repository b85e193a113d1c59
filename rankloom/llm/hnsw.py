"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays.

Equal vectors are one node that remembers its smallest ids (one more than can be asked for, so the answer loses
nothing); nodes are dealt to shards of bounded size by a hash of the vector, each shard is one graph, built in one task
and kept as packed arrays in a written table. Queries are taken in blocks of bounded size; a block is broadcast, walks
every shard's graph, and the shards' candidates, already ranked by exact cosines of the original vectors in double
precision, are merged.

Defined cases: vectors that are null, empty, zero, hold nulls or non-finite values, or differ in length from most, take
no part, neither as queries nor as candidates; rows with a null id take no part; an id that occurs with several vectors
is a candidate with each, and reported once with its best; ties go to the smaller id; a query with fewer candidates
than asked for gets all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import table

#: Most nodes of a shard, on average.
SHARD_NODES = 8192
#: Queries in a block.
BLOCK_QUERIES = 1 << 15
M = 12
EF_BUILD = 60
EF_SEARCH = 128


class Graph:
    """Nodes in order of insertion. Layer 0 has up to 2 * m neighbours a node, others m, all in int32 arrays padded with -1."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        level = np.minimum((-np.log(np.maximum(np.random.default_rng(seed).random(n), 1e-12)) / np.log(m)).astype(np.int64), 12)
        self.level = level
        top = int(level.max()) if n else 0
        #: per layer: row of each node in that layer's neighbour array
        self.row = [np.full(n, -1, np.int32) for _ in range(top + 1)]
        self.near = []
        for l in range(top + 1):
            own = np.flatnonzero(level >= l)
            self.row[l][own] = np.arange(len(own))
            self.near.append(np.full((len(own), 2 * m if l == 0 else m), -1, np.int32))
        self.stamp, self.seen = 0, np.zeros(n, np.int64)
        self.entry, self.top, self.m = 0, int(level[0]) if n else 0, m
        for i in range(1, n):
            self._insert(i, ef)

    def _walk(self, q: np.ndarray, at: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest found from ``at``: (similarity, node), best first."""
        self.stamp += 1
        seen, stamp, near, row, x = self.seen, self.stamp, self.near[layer], self.row[layer], self.x
        best = list(at)
        heapq.heapify(best)
        todo = [(-s, v) for s, v in at]
        heapq.heapify(todo)
        seen[[v for _, v in at]] = stamp
        while todo:
            s, v = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            ns = near[row[v]]
            ns = ns[ns >= 0]
            ns = ns[seen[ns] != stamp]
            if not len(ns):
                continue
            seen[ns] = stamp
            sims = x[ns] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                ns, sims = ns[good], sims[good]
            for t, u in zip(sims.tolist(), ns.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (t, u))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, u))
                else:
                    continue
                heapq.heappush(todo, (-t, u))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Neighbours that spread: one is kept if it's nearer to the new node than to those kept before; gaps are filled up."""
        if len(found) <= m:
            return [v for _, v in found]
        nodes = np.array([v for _, v in found])
        between = self.x[nodes] @ self.x[nodes].T
        kept: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(kept) == m:
                break
            if not kept or between[k, kept].max() <= s:
                kept.append(k)
        chosen = set(kept)
        kept += [k for k in range(len(found)) if k not in chosen][: m - len(kept)]
        return nodes[kept].tolist()

    def _insert(self, i: int, ef: int) -> None:
        q, own = self.x[i], int(self.level[i])
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(self.top, own, -1):
            at = self._walk(q, at, 1, layer)[:1]
        for layer in range(min(self.top, own), -1, -1):
            at = self._walk(q, at, ef, layer)
            m = 2 * self.m if layer == 0 else self.m
            chosen = self._choose(at, self.m)
            near, row = self.near[layer], self.row[layer]
            near[row[i], : len(chosen)] = chosen
            for v in chosen:
                line = near[row[v]]
                free = int((line >= 0).sum())
                if free < m:
                    line[free] = i
                else:
                    all_ = np.append(line, i)
                    sims = self.x[all_] @ self.x[v]
                    o = np.argsort(-sims, kind="stable")
                    line[:] = self._choose([(float(sims[k]), int(all_[k])) for k in o], m)
        if own > self.top:
            self.entry, self.top = i, own

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(self.top, 0, -1):
            at = self._walk(q, at, 1, layer)[:1]
        return [v for _, v in self._walk(q, at, ef, 0)]


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where("vec_id is not null and v is not null").where((F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In double precision, of a vector with rows."""
    return (x @ q) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def build(rows: DataFrame, k: int, shard_nodes: int = SHARD_NODES, m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """(shard, graph): a packed graph per shard, materialised. Every distinct vector is a node with its k + 1 smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)  # a limit per window also runs before the shuffle
    nodes = table(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(1, -(-nodes.count() // shard_nodes))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        o = np.lexsort(x.T[::-1])  # any order will do, but the same for the same shard
        x, ids = x[o], pdf["ids"].to_numpy()[o]
        norm = x / np.abs(x).max(axis=1, keepdims=True)
        norm /= np.sqrt((norm * norm).sum(axis=1, keepdims=True))
        packed = pickle.dumps((x, [np.asarray(i, np.int64) for i in ids], Graph(norm, m, ef)), protocol=5)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "graph": [packed]})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return table(dealt.groupBy("shard").applyInPandas(graph, "shard int, graph binary"), "graphs")


def _search_block(graphs: DataFrame, ids: np.ndarray, block: np.ndarray, k: int, ef: int) -> DataFrame:
    share = graphs.sparkSession.sparkContext.broadcast((ids, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(1):
                x, members, graph = pickle.loads(packed.as_py())
                out: list[tuple[int, int, float]] = []
                for query_id, q in zip(share.value[0].tolist(), share.value[1], strict=True):
                    unit = q / np.abs(q).max()
                    nodes = graph.search((unit / np.sqrt((unit * unit).sum())).astype(np.float32), ef)
                    sims = cosine(q, x[nodes])
                    best: dict[int, float] = {}
                    least = float("inf")
                    for s, v in sorted(zip(sims.tolist(), nodes, strict=True), reverse=True):
                        if len(best) >= k and s < least:  # all nodes that tie with the last one needed have their say
                            break
                        least = s
                        for i in members[v].tolist():
                            if i != query_id:
                                best.setdefault(i, s)
                    out += [(query_id, i, s) for i, s in sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return graphs.repartition(max(1, min(graphs.count(), 4096)), "shard").mapInArrow(run, "query_id long, vec_id long, score double")


def search(rows: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, shard_nodes: int = SHARD_NODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, but never the row with its own id."""
    spark = rows.sparkSession
    # one length of vectors: the commonest
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    rows, queries = (d.where(F.size("v") == sizes[0]["n"]) for d in (rows, queries))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    graphs = build(rows, k, shard_nodes)
    asked = table(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    found = None
    for b in range(blocks := -(-n // block_queries)):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toPandas()
        if len(part):
            hits = _search_block(graphs, part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64), k, ef)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return empty
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
