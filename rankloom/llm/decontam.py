"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. As a set of
word shingles, a window occurs in a document only if all of its shingles do, so the prefix that must be joined, after
ordering shingles by how rare they are in all documents, is one shingle: the rarest. Documents are scanned for these
prefix shingles; each hit gives the place where the window would have to start, which the bounds on position and length
may already refuse, and the words of the item-sized window there are then compared exactly.

Items are used in blocks of bounded size, each block one scan of the documents against a broadcast index; results of
blocks are merged by document. So any number of items works, and nothing grows with the documents but the scan.

Defined cases: null texts have no words, items without words no windows; repeated item rows count once; a document row
is judged by itself, so repeated rows and ties give equal rows; an item with a null id marks words but isn't listed;
an empty table of items leaves every document clean; columns other than ids and texts are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textblocks as tb
from .shared import arrow_rows, table

WINDOW = 10
SHINGLE = 5
#: Bytes of item text in a block, which bound the broadcast index.
BLOCK_BYTES = 8 << 20

SPANS = "row long, doc_id long, n_words long, starts binary, ends binary, items binary"


def _block(texts: pa.Array) -> tuple:
    """Lower-cased buffer, word bounds, owners and hashes of a column of texts."""
    raw, off = tb.arrow_block(texts)
    buf = tb.LOWER[raw]
    start, end, owner = tb.words(buf, off, tb.ALNUM)
    return buf, off, start, end, owner, tb.byte_prefix(buf).slices(start, end) if len(start) else np.zeros(0, np.uint64)


class Index:
    """Windows of a block of items by the shingle that stands for them; ``rarity`` orders shingles by document counts."""

    def __init__(self, items: list[tuple[int | None, str]], window: int, shingle: int) -> None:
        self.ids = sorted({i for i, _ in items if i is not None})
        rank = {i: k for k, i in enumerate(self.ids)}
        buf, off, start, end, owner, h = _block(pa.array([t for _, t in items], pa.string()))
        n = tb.counts(owner, len(items))
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        text = buf.tobytes()
        found: dict[tuple[bytes, ...], set[int]] = {}
        hashes: dict[tuple[bytes, ...], np.ndarray] = {}
        for k, (i, _) in enumerate(items):
            size = min(window, int(n[k]))
            for a in range(first[k], first[k] + n[k] - size + 1 if size else first[k]):
                key = tuple(text[s:e] for s, e in zip(start[a : a + size].tolist(), end[a : a + size].tolist(), strict=True))
                found.setdefault(key, set()).update([rank[i]] if i is not None else [])
                hashes[key] = h[a : a + size]
        self.windows = list(found)
        self.owners = [sorted(found[w]) for w in self.windows]
        #: by shingle length: (hash, window, offset in it) of every shingle of every window
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list] = {}
        for k, w in enumerate(self.windows):
            size = min(shingle, len(w))
            g = tb.shingles(hashes[w], size)
            by.setdefault(size, []).append((g, np.full(len(g), k), np.arange(len(g))))
        for size, parts in by.items():
            self.grams[size] = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        self.known = {size: np.unique(g[0]) for size, g in self.grams.items()}
        self.prefix: dict[int, tuple] = {}

    def order(self, seen: dict[int, dict[int, int]]) -> None:
        """Keeps each window's rarest shingle; of equally rare ones that of the smaller hash."""
        for size, (g, window, offset) in self.grams.items():
            rare = np.array([seen.get(size, {}).get(int(x), 0) for x in self.known[size]], np.int64)
            count = rare[np.searchsorted(self.known[size], g)]
            o = np.lexsort((offset, g, count, window))
            keep = o[np.concatenate([[True], window[o][1:] != window[o][:-1]])]
            keep = keep[np.argsort(g[keep], kind="stable")]
            values, at = np.unique(g[keep], return_index=True)
            self.prefix[size] = (values, np.append(at, len(keep)), window[keep], offset[keep])
        self.grams = {}


def _hits(values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in h, their places in the sorted values)."""
    if not len(values) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a small table of the top bits refuses nearly all before the search
    bits = 20
    seen = np.zeros(1 << bits, bool)
    seen[values >> np.uint64(64 - bits)] = True
    at = np.flatnonzero(seen[h >> np.uint64(64 - bits)])
    k = np.searchsorted(values, h[at])
    k[k == len(values)] = 0
    good = values[k] == h[at]
    return at[good], k[good]


def document_counts(docs: DataFrame, known: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How many times each known shingle occurs in all documents, by shingle length. As many results as known shingles."""
    share = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {size: np.zeros(len(v), np.int64) for size, v in share.value.items()}
        for batch in batches:
            *_, owner, h = _block(batch.column(0))
            for size, values in share.value.items():
                at = tb.windows(h, owner, size)
                _, k = _hits(values, tb.shingles(h, size)[at])
                total[size] += np.bincount(k, minlength=len(values))
        for size, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), size, np.int32)), pa.array(k), pa.array(n[k])], names=["size", "k", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "size int, k long, n long").groupBy("size", "k").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {size: {} for size in known}
    for size, k, n in counted.collect():
        out[size][int(known[size][k])] = n
    return out


def _occurrences(index: Index, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(word count and first word of each text, [(first word, end word, window)]) with every verified occurrence."""
    buf, off, start, end, owner, h = _block(texts)
    n = tb.counts(owner, len(texts))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    found = []
    raw = None
    for size, (values, bounds, window, offset) in index.prefix.items():
        at = tb.windows(h, owner, size)
        place, k = _hits(values, tb.shingles(h, size)[at])
        place = at[place]
        many = bounds[k + 1] - bounds[k]
        place, k = np.repeat(place, many), np.repeat(bounds[k], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        w = window[k]
        begin, length = place - offset[k], np.array([len(x) for x in index.windows])[w] if len(w) else np.zeros(0, np.int64)
        own = owner[place]
        fits = (begin >= first[own]) & (begin + length <= first[own] + n[own])
        for a, m, x in zip(begin[fits].tolist(), length[fits].tolist(), w[fits].tolist(), strict=True):
            raw = buf.tobytes() if raw is None else raw
            if all(raw[start[a + j] : end[a + j]] == word for j, word in enumerate(index.windows[x])):
                found.append((a, a + m, x))
    return n, first, found


def spans(docs: DataFrame, index: Index) -> DataFrame:
    """A row for each document row: its word count, disjoint word ranges that are hit, and the items with occurrences."""
    share = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = share.value
        ids = np.array(index.ids, np.int64)
        for batch in batches:
            n, first, found = _occurrences(index, batch.column(2))
            cols: list[list] = [[], [], []]
            per: dict[int, list] = {}
            last = np.searchsorted(first, [a for a, *_ in found], side="right") - 1 if found else []
            # documents without words share their first word's place with the next one; the owner is the last of them
            for (a, b, x), d in zip(found, last, strict=True):
                per.setdefault(int(d), []).append((a, b, x))
            for d in range(len(n)):
                hit: list[list[int]] = []
                items: set[int] = set()
                for a, b, x in sorted(per.get(d, ())):
                    items.update(index.owners[x])
                    a, b = a - int(first[d]), b - int(first[d])
                    if hit and a <= hit[-1][1]:
                        hit[-1][1] = max(hit[-1][1], b)
                    else:
                        hit.append([a, b])
                spans_ = np.array(hit, np.int64).reshape(-1, 2)
                for c, v in zip(cols, (spans_[:, 0], spans_[:, 1], ids[sorted(items)]), strict=True):
                    c.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *[pa.array(c, pa.binary()) for c in cols]], names=[f.split()[0] for f in SPANS.split(", ")])

    return docs.mapInArrow(run, SPANS)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks, read one at a time: the driver never holds more than a block and one partition."""
    block, size, any_ = [], 0, False
    for i, t in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct().toLocalIterator():
        block.append((i, t))
        size, any_ = size + len(t), True
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block or not any_:
        yield block


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[], [], [], []]
        for starts, ends, items in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            a = np.concatenate([np.frombuffer(x, np.int64) for x in starts])
            b = np.concatenate([np.frombuffer(x, np.int64) for x in ends])
            ids = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in items]))
            if len(a) > 1:
                o = np.argsort(a, kind="stable")
                a, b = a[o], np.maximum.accumulate(b[o])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            for c, v in zip(rows, (a.tolist(), b.tolist(), ids.tolist(), int((b - a).sum())), strict=True):
                c.append(v)
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(rows[3], pa.int64()), pa.array(rows[0], many), pa.array(rows[1], many), pa.array(rows[2], many)],
            names=["row", "doc_id", "n_words", "n_hit", "hit_starts", "hit_ends", "items"],
        )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, hit_starts, hit_ends, items) of every row of ``docs``: hit word ranges and items found."""
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    size = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    single = size < block_bytes
    rows = docs.select(F.lit(0).cast("long").alias("row") if single else F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not single:  # rows are told apart over several scans by a number that must stay the same
        rows = table(rows, "decontam-docs")
    found = None
    for block in _blocks(items, block_bytes):
        index = Index(block, window, shingle)
        index.order(document_counts(rows, index.known))
        part = spans(rows, index)
        found = part if found is None else found.unionByName(part)
    merged = "row long, doc_id long, n_words long, n_hit long, hit_starts array<long>, hit_ends array<long>, items array<long>"
    if single:
        grouped = found.select("row", "doc_id", "n_words", *[F.array(c).alias(c) for c in ("starts", "ends", "items")])
    else:
        grouped = found.groupBy("row", "doc_id", "n_words").agg(*[F.collect_list(c).alias(c) for c in ("starts", "ends", "items")])
    return grouped.mapInArrow(_merge_spans, merged).drop("row")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op4 query."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item window occurs; blocks of items filter one after another."""
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = docs.schema
    for block in _blocks(items, block_bytes):
        index = Index(block, window, shingle)
        index.order(document_counts(docs, index.known))
        share = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, first, found = _occurrences(share.value, batch.column("text"))
                keep = np.ones(batch.num_rows, bool)
                if found:
                    keep[np.searchsorted(first, [a for a, *_ in found], side="right") - 1] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
