"""Dense scoring: a block of query vectors against every corpus vector, in numpy on Arrow batches.

Queries are a stated set, taken in blocks of bounded size and broadcast; the corpus is never shuffled. Scores are made and
used up in tiles of bounded size. What a task gives back, once it has seen all its rows, is the best few of every query and
its partial sums; with more blocks than one the corpus is read in ``SPLITS`` parts for each, so that this grows with the
queries alone.

Vectors take part if all their components are there and finite and they are as long as the first query's; others have
no scores, whether they are documents or queries. A zero vector has the cosine 0 with everything. Ids are of any one type.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .rank import UNIT_PLACES, ranked

_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
#: Queries in a block.
BLOCK = 4096
#: Scores in a tile, and the documents it has at most.
TILE, WIDE = 1 << 20, 4096
#: Parts of the corpus for each block, where there are more blocks than one.
SPLITS = 32


def valid(vector: Column) -> Column:
    """Whether all components are there and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _finite(vector: list | None) -> bool:
    return bool(vector) and all(x is not None for x in vector) and bool(np.isfinite(vector).all())


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, list[list]]]:
    """Blocks of (ids, vectors or lists of vectors) of the queries with a valid vector, all of one length, fetched a partition at a time."""
    nested = "vectors" in queries.columns
    ids, rows, width = [], [], None
    for r in queries.select("query_id", "vectors" if nested else "vector").toLocalIterator():
        known = [v for v in (r[1] or [] if nested else [r[1]]) if _finite(v)]
        if not known:
            continue
        if {len(v) for v in known} != {width := width or len(known[0])}:
            raise ValueError("query vectors must have one length")
        ids.append(r[0])
        rows.append(known)
        if len(ids) == BLOCK:
            yield array_of(ids), rows
            ids, rows = [], []
    if ids:
        yield array_of(ids), rows


def array_of(values: list) -> np.ndarray:
    out = np.array(values)
    return out if out.dtype.kind in "iu" else np.array(values, object)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors over their lengths; scaled first, so that squares neither overflow nor vanish."""
    top = np.abs(x).max(axis=-1, keepdims=True)
    x = x / np.where(top == 0, 1, top)
    n = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _known(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the valid vectors that are ``dim`` long, and these vectors."""
    at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    x = _matrix(column if len(at) == len(column) else column.take(pa.array(at))).reshape(len(at), dim)
    ok = np.isfinite(x).all(axis=1)
    return (at, x) if ok.all() else (at[ok], x[ok])


class _Cosines:
    """Cosines of single vectors, or the weighted mean or with ``best`` the weighted largest of cosines of slices."""

    def __init__(self, rows: list[list], fields: list[tuple[int, int, float]] | None = None, best: bool = False) -> None:
        self.fields, self.best, self.dim = fields, best, len(rows[0][0])
        self.total = 1.0 if fields is None or best else sum(w for *_, w in fields) or 1.0
        self.q, self.order = self._side(np.array([r[0] for r in rows], np.float64), True), np.arange(len(rows))

    def _side(self, v: np.ndarray, query: bool) -> list[np.ndarray]:
        if self.fields is None:
            return [_unit(v)]
        parts = [_unit(v[:, a:b]) * (w / self.total if query else 1.0) for a, b, w in self.fields]
        return parts if self.best else [np.hstack(parts)]

    def take(self, column: pa.Array) -> np.ndarray:
        """The places of the documents that are scored now, in the order of a tile's columns."""
        at, x = _known(column, self.dim)
        self.x = self._side(x, False) if len(at) else []
        return at

    def tile(self, a: int, b: int, c: int, e: int) -> np.ndarray:
        s = self.q[0][a:b] @ self.x[0][c:e].T
        for q, x in zip(self.q[1:], self.x[1:], strict=True):
            np.maximum(s, q[a:b] @ x[c:e].T, out=s)
        return s


def _slots(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows by how many vectors they have, most first; and the first vectors of those that have one, the second vectors of those that have two, ..."""
    order, unit = np.argsort(-counts, kind="stable"), _unit(flat) if len(flat) else flat
    start, most = np.cumsum(counts) - counts, counts[order]
    return order, [unit[start[order[: np.searchsorted(-most, -j)]] + j] for j in range(most[0] if len(most) else 0)]


class _Lists:
    """For each vector of a query its best cosine with a document's vectors, 0 at least, or their ``mean``, or the ``softmax`` vote; summed up.

    With ``whole``, documents without vectors are scored too, by 0.
    """

    def __init__(self, rows: list[list], how: str = "max", whole: bool = False) -> None:
        self.how, self.whole, self.dim = how, whole, len(rows[0][0])
        self.order, self.q = _slots(np.array([v for r in rows for v in r], np.float64), np.array([len(r) for r in rows]))

    def take(self, column: pa.Array) -> np.ndarray:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at, flat = _known(column.flatten(), self.dim)
        counts = np.bincount(np.repeat(np.arange(len(column)), sizes)[at], minlength=len(column))
        order, self.x = _slots(flat, counts)
        self.n = counts[order]
        return order if self.whole else order[self.n > 0]

    def tile(self, a: int, b: int, c: int, e: int) -> np.ndarray:
        total = np.zeros((b - a, e - c))
        for q in self.q:
            if len(q) <= a:
                break
            q = q[a:b]
            own = np.zeros((len(q), e - c))  # for the largest, 0 at least
            for x in self.x:
                if len(x) <= c:
                    break
                s = q @ x[c:e].T
                part = own[:, : s.shape[1]]
                if self.how == "max":
                    np.maximum(part, s, out=part)
                else:
                    part += s if self.how == "mean" else np.exp(s, out=s)
            if self.how != "max":
                n = self.n[c:e]
                own /= np.maximum(n, 1)
                if self.how == "softmax":
                    np.log(own, out=own, where=n > 0)
            total[: len(q)] += own
        return total


class Best:
    """The ``k`` best of each query so far: by score to so many places, then the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, places: int = UNIT_PLACES) -> None:
        self.ids, self.k, self.places = ids, k, places
        self.score, self.key = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -np.inf)
        self.docs = None

    def add(self, a: int, s: np.ndarray, docs: np.ndarray) -> None:
        """``s``: scores of the queries from ``a`` on, and ``docs``; -inf where there is none."""
        rows = slice(a, a + len(s))
        if self.docs is None:
            self.docs = np.zeros(self.score.shape, docs.dtype)
        floor = self.key[rows, -1]
        if s.shape[1] > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(s, -self.k, axis=1)[:, -self.k])
        floor = np.maximum(floor - 1.5 * 10.0**-self.places, -np.finfo(float).max)  # what rounding makes equal stays
        row, col = np.nonzero(s >= floor[:, None])
        if not len(row):
            return
        old, place = np.nonzero(np.isfinite(self.score[rows]))
        score = np.concatenate([self.score[rows][old, place], s[row, col]])
        docs = np.concatenate([self.docs[rows][old, place], docs[col]])
        row, key = np.concatenate([old, row]), np.round(score, self.places)
        order = np.argsort(docs, kind="stable")
        for by in (-key, row):
            order = order[np.argsort(by[order], kind="stable")]
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row]
        keep = place < self.k
        row, place, order = row[keep], place[keep], order[keep]
        self.score[rows], self.key[rows] = -np.inf, -np.inf
        for held, new in ((self.score, score), (self.key, key), (self.docs, docs)):
            held[a + row, place] = new[order]

    def columns(self) -> tuple | None:
        """(query ids, document ids, scores), if there are any."""
        row, place = np.nonzero(np.isfinite(self.score))
        return (self.ids[row], self.docs[row, place], self.score[row, place]) if len(row) else None


class Moments:
    """Number, mean, sum of squared deviations and largest of each query's scores so far."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.n, self.top = ids, np.zeros(len(ids)), np.full(len(ids), -np.inf)
        self.mean, self.ss = np.zeros(len(ids)), np.zeros(len(ids))

    def add(self, a: int, s: np.ndarray, there: np.ndarray | None = None) -> None:
        """``there``: which scores count, else all."""
        rows = slice(a, a + len(s))
        count = np.full(len(s), s.shape[1]) if there is None else there.sum(axis=1)
        seen = {} if there is None else {"where": there}
        mean = s.sum(axis=1, **seen) / np.maximum(count, 1)
        ss = np.square(np.subtract(s, mean[:, None], **(seen and seen | {"out": np.zeros(s.shape)}))).sum(axis=1)
        n, apart = self.n[rows] + count, mean - self.mean[rows]
        self.ss[rows] += ss + apart**2 * self.n[rows] * count / np.maximum(n, 1)
        self.mean[rows] += apart * count / np.maximum(n, 1)
        self.n[rows] = n
        self.top[rows] = np.maximum(self.top[rows], s.max(axis=1, **(seen and seen | {"initial": -np.inf})))

    def columns(self) -> tuple | None:
        """(query ids, n, mean, ss, top) of queries with any score."""
        ok = self.n > 0
        return (self.ids[ok], self.n[ok].astype(np.int64), self.mean[ok], self.ss[ok], self.top[ok]) if ok.any() else None


def emit(cols: tuple, names: list[str], kinds: list) -> pa.RecordBatch:
    """A batch of arrays; None stands for a column of nulls."""
    n = next(len(c) for c in cols if c is not None)
    put = lambda c, k: pa.nulls(n, k) if c is None else pa.array(c.tolist() if c.dtype == object else c, k)
    return pa.RecordBatch.from_arrays([put(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def parsed(schema: str) -> tuple[list[str], list]:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return list(names), [_ARROW.get(k) for k in kinds]


def _map(corpus: DataFrame, queries: DataFrame, sides: Callable, start: Callable, schema: str, extra: list[Column]) -> DataFrame:
    """What a task makes of its documents for each block of queries.

    ``sides`` makes a block's scorer of its vectors. ``start`` of (ids, scorer) gives two generators of columns: one of (document
    ids, extra columns) for each batch, whose scores are the scorer's tiles, and one for what is left at the end.
    """
    name = "vectors" if "vectors" in corpus.columns else "vector"
    kind = dict(corpus.dtypes)[name]
    vector = F.col(name) if kind.endswith(("<double>", "<float>", "<double>>", "<float>>")) else F.col(name).cast("array<" * kind.count("array<") + "double" + ">" * kind.count("array<"))
    rows = corpus.select("doc_id", vector.alias("vector"), *extra)
    names, kinds = parsed(schema)
    out = None
    blocks = _blocks(queries)
    first = [b for b in (next(blocks, None), next(blocks, None)) if b is not None]
    if len(first) > 1:
        rows = rows.coalesce(SPLITS)
    for ids, q in (*first, *blocks):
        share = corpus.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            ids, q = share.value
            scorer = sides(q)
            step, rest = start(ids[scorer.order], scorer)
            for batch in batches:
                if batch.num_rows and len(at := scorer.take(batch.column(1))):
                    docs = array_of(batch.column(0).take(pa.array(at)).to_pylist())
                    for cols in step(docs, *[np.asarray(c.take(pa.array(at)).to_pylist(), object) for c in batch.columns[2:]]):
                        yield emit(cols, names, kinds)
            for cols in rest():
                yield emit(cols, names, kinds)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else corpus.sparkSession.createDataFrame([], schema)


def _tiles(n: int, docs: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to) of queries and of documents."""
    for c in range(0, docs, WIDE):
        e = min(c + WIDE, docs)
        deep = max(1, TILE // (e - c))
        for a in range(0, n, deep):
            yield a, min(a + deep, n), c, e


def _selves(ids: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from document ids to the places (query, document) where both are one."""
    places = defaultdict(list)
    for i, v in enumerate(ids.tolist()):
        places[v].append(i)

    def find(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = [(i, j) for j, v in enumerate(docs.tolist()) if v in places for i in places[v]]
        return tuple(np.array(met, np.int64).reshape(-1, 2).T)

    return find


def _within(met: tuple[np.ndarray, np.ndarray], a: int, b: int, c: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = met
    ok = (i >= a) & (i < b) & (j >= c) & (j < e)
    return i[ok] - a, j[ok] - c


def _types(corpus: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["doc_id"]


def _prior(prior: Column | None) -> list[Column]:
    return [] if prior is None else [F.coalesce(prior.cast("double"), F.lit(0.0)).alias("prior")]


def _scored(ids: np.ndarray, scorer, docs: np.ndarray, own: tuple[np.ndarray, ...], met: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first query, first and last document, scores) a tile, the prior added; -inf where a query meets itself and where a prior is no finite number."""
    prior = own[0].astype(np.float64) if own else None
    for a, b, c, e in _tiles(len(ids), len(docs)):
        s = scorer.tile(a, b, c, e)
        if prior is not None:
            s += np.where(np.isfinite(prior[c:e]), prior[c:e], -np.inf)
        if met is not None:
            s[_within(met, a, b, c, e)] = -np.inf
        yield a, c, e, s


#: Top rows and rows of moments, of which the other's columns are null.
FOUND = "query_id {}, doc_id {}, score double, n long, m double, ss double, top double"


def _found(corpus: DataFrame, queries: DataFrame, sides: Callable, k: int, prior: Column | None, skip_self: bool, gauge: bool) -> DataFrame:
    """Of each task the ``k`` best of a query (query_id, doc_id, score), if ``k`` isn't 0, and with ``gauge`` a row of its moments (query_id, n, m, ss, top)."""

    def start(ids: np.ndarray, scorer) -> tuple[Callable, Callable]:
        best, sums, find = Best(ids, k) if k else None, Moments(ids) if gauge else None, _selves(ids) if skip_self else None

        def step(docs: np.ndarray, *own: np.ndarray) -> Iterator[tuple]:
            for a, c, e, s in _scored(ids, scorer, docs, own, find(docs) if find else None):
                if best:
                    best.add(a, s, docs[c:e])
                if sums:
                    sums.add(a, s)
            return iter(())

        def rest() -> Iterator[tuple]:
            if best and (top := best.columns()):
                yield *top, None, None, None, None
            if sums and (made := sums.columns()):
                yield made[0], None, None, *made[1:]

        return step, rest

    return _map(corpus, queries, sides, start, FOUND.format(*_types(corpus, queries)), _prior(prior))


def best_of(found: DataFrame, k: int, places: int = UNIT_PLACES) -> DataFrame:
    return ranked(found.where("score is not null").select("query_id", "doc_id", "score"), k, places)


def met_moments(found: DataFrame) -> DataFrame:
    """(query_id, n, mean, ss, top) of partial counts, means and squared deviations."""
    parts = found.where("n is not null").select("query_id", "n", "m", "ss", "top")
    mean = parts.groupBy("query_id").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    return parts.join(mean, "query_id").groupBy("query_id", "mean").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), F.sum(F.col("ss") + F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ss"))


def _confidence(found: DataFrame) -> DataFrame:
    """(query_id, confidence)."""
    whole = met_moments(found)
    std = F.sqrt(F.col("ss") / F.col("n"))
    return whole.select("query_id", F.when(std <= 1e-9, 0.0).otherwise((F.col("top") - F.col("mean")) / std).alias("confidence"))


def topk(corpus: DataFrame, queries: DataFrame, k: int, fields: list[tuple[int, int, float]] | None = None, prior: Column | None = None, skip_self: bool = False, best_field: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best of each query; ``prior`` is a column of the corpus added to the score.

    A query is scored by the weighted mean over ``fields`` (from, to, weight), or with ``best_field`` by the largest weighted field.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    return best_of(_found(corpus, queries, lambda q: _Cosines(q, fields, best_field), k, prior, skip_self, False), k)


def scores(corpus: DataFrame, queries: DataFrame, fields: list[tuple[int, int, float]] | None = None, prior: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every query and document, for small query sets whose full score vectors are wanted."""

    def start(ids: np.ndarray, scorer) -> tuple[Callable, Callable]:
        def step(docs: np.ndarray, *own: np.ndarray) -> Iterator[tuple]:
            for a, c, e, s in _scored(ids, scorer, docs, own):
                yield np.repeat(ids[a : a + len(s)], e - c), np.tile(docs[c:e], len(s)), s.ravel()

        return step, lambda: iter(())

    a, b = _types(corpus, queries)
    return _map(corpus, queries, lambda q: _Cosines(q, fields), start, f"query_id {a}, doc_id {b}, score double", _prior(prior))


def _check(how: str) -> None:
    if how not in ("max", "mean", "softmax"):
        raise KeyError(how)


def grouped(corpus: DataFrame, queries: DataFrame, owner: str, how: str = "max", skip_self: bool = True) -> DataFrame:
    """(query_id, owner, score) over each owner's vectors: the best cosine, 0 at least; the ``mean``; or the ``softmax`` vote, the log of the mean of exp.

    With ``skip_self`` a query's own vector takes no part. For owners that are few; of many, ``pool_lists`` gives the best.
    """
    _check(how)

    def start(ids: np.ndarray, scorer) -> tuple[Callable, Callable]:
        find, names, held = _selves(ids) if skip_self else None, {}, []

        def columns(rows: slice, owners: list, n: np.ndarray, top: np.ndarray, total: np.ndarray) -> tuple:
            own = np.empty(len(owners), object)
            own[:] = owners
            return np.repeat(ids[rows], len(owners)), np.tile(own, len(n)), n.ravel(), top.ravel(), total.ravel()

        def rest() -> Iterator[tuple]:
            if names:
                yield columns(slice(None), list(names), *held)
            names.clear()
            held.clear()

        def step(docs: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
            here = {v: i for i, v in enumerate(dict.fromkeys(own.tolist()))}
            at, every = np.array([here[v] for v in own.tolist()]), list(here)
            met = find(docs) if find else None
            new = [v for v in here if v not in names]
            keeps = len(here) * len(ids) <= TILE
            if keeps and (len(names) + len(new)) * len(ids) > TILE:
                yield from rest()
                new = list(here)
            if keeps and new:
                more = [np.full((len(ids), len(new)), v) for v in (0.0, -1.0, 0.0)]
                held[:] = [np.hstack([x, y]) for x, y in zip(held, more, strict=True)] if held else more
                names.update({v: len(names) + i for i, v in enumerate(new)})
            for a, b, c, e in _tiles(len(ids), len(docs)):
                s, order = scorer.tile(a, b, c, e), np.argsort(at[c:e], kind="stable")
                codes, starts = np.unique(at[c:e][order], return_index=True)
                value = s.copy() if how == "mean" else np.exp(s) if how == "softmax" else None
                n = np.tile(np.diff([*starts, e - c]).astype(float), (b - a, 1))
                if met is not None:
                    i, j = _within(met, a, b, c, e)
                    s[i, j] = -1.0
                    np.subtract.at(n, (i, np.searchsorted(codes, at[c:e][j])), 1.0)
                    if value is not None:
                        value[i, j] = 0.0
                top = np.maximum.reduceat(s[:, order], starts, axis=1)
                total = np.add.reduceat(value[:, order], starts, axis=1) if value is not None else np.zeros(n.shape)
                owners = [every[x] for x in codes.tolist()]
                if keeps:
                    to = np.ix_(np.arange(a, b), [names[v] for v in owners])
                    held[0][to] += n
                    held[1][to] = np.maximum(held[1][to], top)
                    held[2][to] += total
                else:
                    yield columns(slice(a, b), owners, n, top, total)

        return step, rest

    a, _ = _types(corpus, queries)
    found = _map(corpus, queries, _Cosines, start, f"query_id {a}, owner {dict(corpus.dtypes)[owner]}, n double, top double, total double", [F.col(owner)])
    mean = F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))
    value = {"max": F.greatest(F.max("top"), F.lit(0.0)), "mean": F.coalesce(mean, F.lit(0.0)), "softmax": F.coalesce(F.ln(mean), F.lit(0.0))}[how]
    return found.groupBy("query_id", "owner").agg(value.alias("score"))


def sums(corpus: DataFrame, queries: DataFrame, fields: list[tuple[int, int, float]] | None = None, prior: Column | None = None) -> DataFrame:
    """(query_id, confidence) over all corpus scores, from partial counts, means and squared deviations."""
    return _confidence(_found(corpus, queries, lambda q: _Cosines(q, fields), 0, prior, False, True).persist())


def pool(corpus: DataFrame, queries: DataFrame, k: int, fields: list[tuple[int, int, float]] | None = None, prior: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``topk`` and ``sums`` in one pass over the corpus."""
    found = _found(corpus, queries, lambda q: _Cosines(q, fields), k, prior, False, True).persist()  # a few rows a query and task
    return best_of(found, k), _confidence(found)


def pool_lists(corpus: DataFrame, queries: DataFrame, k: int, how: str = "max", prior: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The same over documents (doc_id, vectors) with any number of vectors each, none included: their best cosine, 0 at least, their ``mean`` or ``softmax`` vote, or 0."""
    _check(how)
    found = _found(corpus, queries, lambda q: _Lists(q, how, whole=True), k, prior, False, True).persist()
    return best_of(found, k), _confidence(found)


def max_sim(tokens: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, owner, score, rank), the ``k`` best: for each vector of a query (query_id, vector) its best cosine with the owner's (owner, vector), 0 at least, summed up.

    An owner's vectors meet in one row, so a task sums up and ranks where it is.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    own = tokens.where("vector is not null").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("vector").alias("vectors"))
    each = asked.where("vector is not null").groupBy("query_id").agg(F.collect_list("vector").alias("vectors"))
    return best_of(_found(own, each, _Lists, k, None, False, False), k).withColumnRenamed("doc_id", "owner")


def rocchio(corpus: DataFrame, queries: DataFrame, k: int, keep: float = 1.0, gain: float = 0.75, skip_self: bool = False) -> DataFrame:
    """``queries`` moved towards what they find: ``keep`` times the vector and ``gain`` times the mean of the ``k`` best documents' vectors."""
    found = topk(corpus, queries, k, skip_self=skip_self).select("query_id", "doc_id")
    parts = found.join(corpus.select("doc_id", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x")), "doc_id")
    mean = parts.groupBy("query_id", "i").agg(F.avg("x").alias("x")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    moved = F.zip_with(F.col("vector").cast("array<double>"), F.coalesce("mean", F.col("vector").cast("array<double>")), lambda a, b: F.when(F.col("mean").isNull(), a).otherwise(keep * a + gain * b))
    return queries.join(mean, "query_id", "left").select("query_id", moved.alias("vector"))


def truncated(rows: DataFrame, dim: int) -> DataFrame:
    """``rows`` with the first ``dim`` components of their vectors, for encoders trained so that these say most."""
    return rows.withColumn("vector", F.slice("vector", 1, dim))


def sign_bits(vector: Column) -> Column:
    """Bits of the positive components, 64 to a long."""
    groups = F.sequence(F.lit(0), F.greatest(F.floor((F.size(vector) - 1) / 64), F.lit(0)).cast("int"))
    bits = lambda g: F.aggregate(F.slice(vector, g * 64 + 1, 64), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0).cast("long")))
    return F.transform(groups, bits)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two codes of ``sign_bits`` differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
