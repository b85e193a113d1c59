"""Substring deduplication over a log-structured fingerprint index.

The index keeps sorted immutable runs of anchor fingerprints (hashes of sampled inner windows, see ``repeats``) of all
documents added so far, by bucket, with the chunks they came from, and the chunks themselves. A new batch becomes a run
of its own; bucket by bucket it is merge-joined with the historical runs, which tells what recurs. Candidates are then
verified: the texts of their windows, from history and batch alike, meet and are compared word by word. Runs of one
level are compacted into one of the next once there are ``fanout`` of them. Runs are written tables in the shared
folder; a batch interrupted half way leaves the index as it was.

A word is removed if a window of ``window`` words covers it whose word sequence also starts earlier: in an earlier batch,
in a row of the batch with a smaller doc_id, or in the same row at an earlier start. Windows are judged on the input.

Defined cases: null and empty texts have no words and keep none; texts shorter than a window keep all; different rows
with one id (repeated rows) don't count as earlier for each other; a null id counts as larger than any; an empty batch
adds an empty run and gives an empty result; other columns are carried along by ``clean`` and ignored by the digest.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chunks as ch, repeats as rp, textblocks as tb
from .chunks import Chunk
from .shared import table

WINDOW = 20
SHINGLE = 8
FANOUT = 4

#: A bucket of a run: sorted distinct (fingerprint, chunk) pairs, packed.
RUN = "bucket int, cid long, blob binary"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _run_blob(values: np.ndarray, own: np.ndarray, cids: np.ndarray) -> bytes:
    return ch.squeeze(ch.pack(values, own.astype(np.int32), cids))


def _to_run(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Packets of a bucket as one sorted piece of a run."""
    values = np.frombuffer(b"".join(blobs), np.uint64)
    own = np.repeat(np.arange(len(cids)), [len(b) // 8 for b in blobs])
    order = np.argsort(values, kind="stable")
    yield bucket, -1, _run_blob(values[order], own[order], np.array(cids, np.int64))


def _read_runs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint with its flag, chunk id), sorted by fingerprint: a merge of sorted pieces."""
    values, cids = [], []
    for blob in blobs:
        v, own, names = ch.unpack(ch.expand(blob))
        values.append(v)
        cids.append(names[own])
    v, c = np.concatenate(values), np.concatenate(cids)
    order = np.argsort(v & rp._LOW, kind="stable")  # merges the ascending pieces
    return v[order], c[order]


def _compact(bucket: int, _: list[int], blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    v, c = _read_runs(blobs)
    names, own = np.unique(c, return_inverse=True)
    yield bucket, -1, _run_blob(v, own, names)


def _merge_join(bucket: int, new: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Replies to every chunk that holds a fingerprint of the new batch that recurs; ``new``: 1 for pieces of the new run."""
    v, c = _read_runs([b for n, b in zip(new, blobs, strict=True) if n])if any(new) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(v):
        return
    key = v & rp._LOW
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, weights=(v & np.uint64(1)).astype(float)) > 0)
    distinct = key[np.searchsorted(group, np.arange(len(many)))]
    if any(n == 0 for n in new):
        old_v, old_c = _read_runs([b for n, b in zip(new, blobs, strict=True) if not n])
        old = old_v & rp._LOW
        at = np.searchsorted(distinct, old)
        at[at == len(distinct)] = 0
        hit = distinct[at] == old
        many[at[hit]] = True
        key, c = np.concatenate([key[many[group]], old[hit]]), np.concatenate([c[many[group]], old_c[hit]])
    else:
        key, c = key[many[group]], c[many[group]]
    names, own = np.unique(c, return_inverse=True)
    yield from rp.split_by(own, key, names.tolist())


def _windows(buf: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of words in the texts: text number, class by word sequence (compared exactly), and per text their count and first."""
    start, end, owner = tb.words(buf, off, tb.NOT_SPACE)
    w = tb.windows(start, owner, window)
    s, e = start[w], end[w + window - 1]
    one, two = (tb.byte_prefix(buf, seed).slices(s, e) for seed in (0, 1))
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(order) else np.zeros(0, bool)
    raw, first = buf.tobytes(), 0
    for k in np.flatnonzero(~new).tolist():  # verified: the texts themselves are equal
        i, j = order[k - 1], order[k]
        if raw[s[i] : e[i]] != raw[s[j] : e[j]]:
            new[k] = True
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new) - 1
    count = np.bincount(owner[w], minlength=len(off) - 1)
    return owner[w], cls, count, np.concatenate([[first], np.cumsum(count)])[:-1]


def _verify(window: int):
    def run(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        met = rp.Met(cids, blobs)
        _, cls, count, first = _windows(met.buf, met.off, window)
        w = met.windows.astype(np.int64)
        assert (count[met.context] == w).all()
        entity = np.repeat(np.arange(len(w)), w)
        inner = np.arange(len(entity)) - np.repeat(np.concatenate([[0], np.cumsum(w)])[:-1], w)
        c = cls[first[met.context[entity]] + inner]
        n = int(c.max()) + 1 if len(c) else 0
        batch, ids = met.batch[entity], met.ids[entity]
        start = met.first[entity] + inner
        least_batch = rp.classes_min(c, batch, n)
        oldest = batch == least_batch[c]
        least_id = rp.classes_min(c[oldest], ids[oldest], n)
        earlier = ~oldest | (ids > least_id[c])
        # what is left has the smallest id; in each of its rows all but the first start goes
        rest = np.flatnonzero(~earlier)
        o = rest[np.lexsort((start[rest], met.row[entity[rest]], met.own[entity[rest]], c[rest]))]
        same = (c[o][1:] == c[o][:-1]) & (met.own[entity[o]][1:] == met.own[entity[o]][:-1]) & (met.row[entity[o]][1:] == met.row[entity[o]][:-1])
        earlier[o[1:][same]] = True
        yield from met.removals(earlier, same_too=True)

    return run


@dataclass
class Index:
    """Runs as (level, table); chunk stores of the batches so far. ``buckets`` is fixed by the first batch's size.

    Chunk ids are a partition and a number in it; in the runs, partitions are counted on from batch to batch, so that
    each of any number of batches has a range of ids of its own. ``parts``: partitions of each batch, 0 of an empty one.
    """

    spark: SparkSession
    window: int = WINDOW
    shingle: int = SHINGLE
    fanout: int = FANOUT
    buckets: int = 0
    runs: list[tuple[int, DataFrame]] = field(default_factory=list)
    stores: list[DataFrame] = field(default_factory=list)
    parts: list[int] = field(default_factory=list)

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch; its chunks with, as replies, the windows to remove."""
        chunks, size = ch.store(docs, "substring")
        self.buckets = self.buckets or ch.bucket_count(4 * size)
        window, shingle, buckets, number = self.window, self.shingle, self.buckets, len(self.stores)
        last = chunks.agg(F.max("cid")).first()[0]
        parts = [*self.parts, 0 if last is None else (last >> 32) + 1]
        bounds = [n << 32 for n in itertools.accumulate(parts, initial=0)]
        own_low = bounds[number]

        def sample(chunk: Chunk, _: list[bytes]):
            yield from rp.anchor_packets(chunk.cid + own_low, rp.anchors(rp.word_units(chunk), window, shingle)[2], buckets)

        new = table(ch.over_buckets(ch.over_chunks(chunks, sample, ch.PACKETS), _to_run, RUN), "run")
        mine = new.select("bucket", F.lit(1).cast("long").alias("cid"), "blob")
        for _, old in self.runs:
            mine = mine.unionByName(old.select("bucket", F.lit(0).cast("long").alias("cid"), "blob"))
        again = table(ch.over_buckets(mine, _merge_join, ch.REPLIES), "recurring")
        met = None
        for b, held in enumerate([*self.stores, chunks]):
            low, high = bounds[b : b + 2]
            if low == high and b < number:
                continue

            def send(chunk: Chunk, replies: list[bytes], b: int = b, low: int = low):
                known = np.unique(np.frombuffer(b"".join(replies), np.uint64))
                for bucket, _, blob in rp.contexts(chunk, rp.word_units(chunk), window, shingle, known, buckets, b):
                    yield bucket, chunk.cid + low, blob

            own = again.where((F.col("cid") >= low) & (F.col("cid") < high)).select((F.col("cid") - low).alias("cid"), "blob")
            part = ch.over_chunks(ch.with_replies(held, own, "inner"), send, ch.PACKETS)
            met = part if met is None else met.unionByName(part)
        decided = ch.over_buckets(met, _verify(window), ch.REPLIES)
        mine_only = decided.where(F.col("cid") >= own_low).select((F.col("cid") - own_low).alias("cid"), "blob")
        self.stores.append(chunks)
        self.parts = parts
        self.runs.append((0, new))
        self._settle()
        return ch.with_replies(chunks, mine_only)

    def _settle(self) -> None:
        level = 0
        while len(own := [r for n, r in self.runs if n == level]) >= self.fanout:
            every = own[0]
            for r in own[1:]:
                every = every.unionByName(r)
            merged = table(ch.over_buckets(every, _compact, RUN), f"run-{level + 1}")
            self.runs = [(n, r) for n, r in self.runs if n != level] + [(level + 1, merged)]
            level += 1


def in_batches(docs: DataFrame, batches: int) -> Iterator[DataFrame]:
    """``docs`` by ascending doc_id in ``batches`` parts of about equal size; null ids come last."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    low = None
    for cut in [*cuts, None]:
        part = docs
        if low is not None:
            part = part.where((F.col("doc_id") > low) | F.col("doc_id").isNull() if cut is None else F.col("doc_id") > low)
        if cut is not None:
            part = part.where(F.col("doc_id") <= cut)
        yield part
        low = cut


def flagged(docs: DataFrame, batches: int = 2, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Chunks of all of ``docs``, added batch by batch in order of doc_id, with the windows to remove."""
    index, out = Index(docs.sparkSession, window, shingle), None
    for part in in_batches(docs, batches):
        found = index.add(part)
        out = found if out is None else out.unionByName(found)
    return out


def _kept(chunk: Chunk, replies: list[bytes], window: int) -> tuple[rp.Units, np.ndarray]:
    units = rp.word_units(chunk)
    return units, rp.removed_units(replies, int(units.off[-1]), window)


def digest(docs: DataFrame, batches: int = 2, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def judge(chunk: Chunk, replies: list[bytes]) -> pa.RecordBatch:
        texts, n, gone = _texts(chunk, replies, window)
        return pa.RecordBatch.from_arrays(
            [chunk.batch.column("doc_id"), pa.array(n), pa.array(gone), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return ch.over_chunks(flagged(docs, batches, window, shingle), judge, DIGEST)


def _texts(chunk: Chunk, replies: list[bytes], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Kept words of each row joined by one space, its words and those removed."""
    units, gone = _kept(chunk, replies, window)
    n, lost = np.diff(units.off), np.diff(np.concatenate([[0], np.cumsum(gone)])[units.off])
    keep = ~gone
    size = (units.end - units.start + 1)[keep]
    buf, off = ch.gather(units.buf, units.start[keep], size)
    raw = buf.tobytes()
    at = off[np.concatenate([[0], np.cumsum(n - lost)])]
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], n, lost


def clean(docs: DataFrame, batches: int = 2, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with repeated words cut out of ``text``: rows that lose some keep the others joined by one space."""
    schema = docs.withColumns({"doc_id": docs["doc_id"].cast("long"), "text": docs["text"].cast("string")}).schema

    def cut(chunk: Chunk, replies: list[bytes]) -> pa.RecordBatch:
        texts, _, lost = _texts(chunk, replies, window)
        old = chunk.batch.column("text")
        new = pa.array([t.decode() if gone else old[k].as_py() for k, (t, gone) in enumerate(zip(texts, lost.tolist(), strict=True))], pa.string())
        return chunk.batch.set_column(chunk.batch.schema.get_field_index("text"), "text", new)

    return ch.over_chunks(flagged(docs, batches, window, shingle), cut, schema)
