"""Suffix-array deduplication: two-stage sorting, induced bucket scans, adjacent common prefixes.

Byte strings of ``length`` that also start in a document with a smaller id are removed, on the input as it is. Candidate
contexts meet by anchor (see ``repeats``); where they meet, a suffix array over their distinct texts groups equal
strings: only suffixes smaller than their successors are sorted directly, the others are induced by scanning the
buckets of first bytes in order, and common prefixes of neighbours in the array part the groups.

Defined cases: null and empty texts have no bytes and nothing removed; texts shorter than ``length`` keep all; rows with
equal ids never remove from each other, whatever they hold; a null id counts as larger than any; an empty table gives
an empty result; columns other than doc_id and text are carried along by ``clean`` and ignored by the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as ch, repeats as rp
from .chunks import Chunk

LENGTH = 50
SHINGLE = 20
#: Text bytes to a chunk and to a bucket: numpy holds some 150 bytes for each byte of a chunk, some 300 of the contexts it sorts at a time.
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 1 << 19
SORT_BYTES = 1 << 20
#: Parts contexts; it occurs in no UTF-8 text.
SEPARATOR = 0xFF

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _words(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as one big-endian number; ``t`` is padded by eight bytes at least."""
    key = t[at].astype(np.uint64)
    for k in range(1, 8):
        key <<= np.uint64(8)
        key |= t[at + k]
    return key


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of ``text`` by their first ``depth`` bytes at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)  # 1: smaller than its successor, -1: larger; an end is larger than nothing
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    ends = np.flatnonzero(step)  # in a run of equal bytes, the step that ends it decides
    small = step[ends[np.searchsorted(ends, np.arange(n))]] > 0

    # first stage: sort the smaller ones, eight bytes at a time, going on only where they tie
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    direct = np.flatnonzero(small)
    key = _words(padded, direct)
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    differs = np.concatenate([[True], key[1:] != key[:-1]]) if len(direct) else np.zeros(0, bool)
    for d in range(8, depth, 8):
        group = np.cumsum(differs) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
        if not len(tied):
            break
        key = _words(padded, direct[tied] + d if d + int(direct.max()) + 8 <= len(padded) else np.minimum(direct[tied] + d, len(padded) - 8))
        order = np.lexsort((key, group[tied]))
        direct[tied] = direct[tied][order]
        key, g = key[order], group[tied]
        differs[tied[1:]] |= (key[1:] != key[:-1]) & (g[1:] == g[:-1])

    # second stage: induce the larger ones, bucket by bucket
    lead = text[direct]
    b_at = np.searchsorted(lead, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        bucket.append(direct[b_at[c] : b_at[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for x in np.unique(first).tolist():
            lo, hi = np.searchsorted(first, [x, x + 1])
            induced[x].append(before[lo:hi])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the array, up to ``depth``; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    alive = np.arange(1, len(order))
    for d in range(0, depth, 8):
        a, b = order[alive] + d, order[alive - 1] + d
        # a suffix that has ended has nothing in common any more
        x = _words(padded, np.minimum(a, len(padded) - 8)) ^ _words(padded, np.minimum(b, len(padded) - 8))
        bits = np.zeros(len(x), np.int64)
        for shift in (32, 16, 8):
            top = (x >> np.uint64(64 - shift)) == 0
            full = top & (x != 0)
            bits[full] += shift
            x = np.where(full, x << np.uint64(shift), x)
        lcp[alive] = d + np.where(x == 0, 8, bits // 8)
        alive = alive[x == 0]
        if not len(alive):
            break
    longest = np.concatenate([[0], len(text) - np.maximum(order[1:], order[:-1])])
    return np.minimum(np.minimum(lcp, longest), depth)


def equal_strings(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of all strings of ``length`` within the texts: (their places in ``buf``, class of each, number of classes)."""
    text = np.full(len(buf) + len(off), SEPARATOR, np.uint8)
    shift = np.repeat(np.arange(len(off) - 1), np.diff(off))
    text[np.arange(len(buf)) + shift] = buf
    order = suffix_array(text, length)
    group = np.cumsum(common_prefixes(text, order, length) < length)
    size = np.diff(off)
    valid = np.zeros(len(text), bool)
    places, _ = ch.gather(np.arange(len(text)), off[:-1] + np.arange(len(size)), np.maximum(size - length + 1, 0))
    valid[places] = True
    order, group = order[valid[order]], group[valid[order]]
    _, cls = np.unique(group, return_inverse=True)
    owner = np.searchsorted(off[:-1] + np.arange(len(size)), order, side="right") - 1
    return order - owner, cls, int(cls.max()) + 1 if len(cls) else 0


def _decide(length: int):
    def run(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        met = rp.Met(cids, blobs)
        n_text = len(met.off) - 1
        # smallest id that has each distinct context
        least = rp.classes_min(met.context, met.ids, n_text)
        # windows of a context are all different and equal ones have one anchor, so a context that is alone with its anchor needs no sorting
        anchor = np.unique(met.anchor, return_inverse=True)[1]
        mixed = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
        size = np.diff(met.off)
        by_place = np.repeat(least, size)
        for part in _parts(anchor[mixed], size[mixed]):
            texts = mixed[part]
            buf, off = ch.gather(met.buf, met.off[:-1][texts], size[texts])
            places, cls, n = equal_strings(buf, off, length)
            text_of = np.searchsorted(off, places, side="right") - 1
            first = rp.classes_min(cls, least[texts[text_of]], n)
            by_place[places - off[text_of] + met.off[:-1][texts[text_of]]] = first[cls]
        w = met.windows.astype(np.int64)
        at, _ = ch.gather(by_place, met.off[:-1][met.context], w)
        yield from met.removals(at < np.repeat(met.ids, w), same_too=False)

    return run


def _parts(anchor: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The contexts dealt into parts of about SORT_BYTES that keep those of an anchor together, for which a suffix array is made at a time."""
    order = np.argsort(anchor, kind="stable")
    if not len(order):
        return
    ends = np.flatnonzero(np.append(np.diff(anchor[order]) != 0, True)) + 1
    total = np.cumsum(size[order])
    lo, before = 0, 0
    for hi in ends.tolist():
        if total[hi - 1] - before >= SORT_BYTES or hi == len(order):
            yield order[lo:hi]
            lo, before = hi, int(total[hi - 1])


def flagged(docs: DataFrame, length: int = LENGTH, shingle: int = SHINGLE) -> DataFrame:
    """The chunks of ``docs`` with, as replies, the windows to remove."""
    chunks, size = ch.store(docs, "suffix", CHUNK_BYTES)
    buckets = ch.bucket_count(size, BUCKET_BYTES)

    def sample(chunk: Chunk, _: list[bytes]):
        units = rp.byte_units(chunk)
        first, _, h = rp.anchors(units, length, shingle)
        yield from rp.anchor_packets(chunk.cid, h, buckets, chunk.ids[units.rows(first)])

    def send(chunk: Chunk, replies: list[bytes]):
        known = np.unique(np.frombuffer(b"".join(replies), np.uint64))
        yield from rp.contexts(chunk, rp.byte_units(chunk), length, shingle, known, buckets)

    again = ch.over_buckets(ch.over_chunks(chunks, sample, ch.PACKETS), rp.recurring, ch.REPLIES)
    met = ch.over_chunks(ch.with_replies(chunks, again, "inner"), send, ch.PACKETS)
    return ch.with_replies(chunks, ch.over_buckets(met, _decide(length), ch.REPLIES))


def digest(docs: DataFrame, length: int = LENGTH, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def judge(chunk: Chunk, replies: list[bytes]) -> pa.RecordBatch:
        gone = rp.removed_units(replies, len(chunk.buf), length)
        edge = np.zeros(len(gone), bool)
        edge[1:] = gone[:-1]
        edge[chunk.off[:-1][chunk.off[:-1] < len(gone)]] = False
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, gone & ~edge))
        kept = chunk.buf[~gone].tobytes()
        at = chunk.off - total[chunk.off]
        shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [chunk.batch.column("doc_id"), *[pa.array(np.diff(x[chunk.off]) if x is not chunk.off else np.diff(x)) for x in (total, spans)], pa.array(np.diff(chunk.off)), pa.array(shas, pa.string())],
            names=["doc_id", "n_removed", "n_spans", "n_bytes", "kept_sha256"],
        ).select(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return ch.over_chunks(flagged(docs, length, shingle), judge, DIGEST)


def clean(docs: DataFrame, length: int = LENGTH, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; a character of which a part is cut goes whole."""
    schema = docs.withColumns({"doc_id": docs["doc_id"].cast("long"), "text": docs["text"].cast("string")}).schema

    def cut(chunk: Chunk, replies: list[bytes]) -> pa.RecordBatch:
        gone = rp.removed_units(replies, len(chunk.buf), length)
        begins = np.flatnonzero((chunk.buf & 0xC0) != 0x80)
        if len(begins):
            size = np.diff(np.append(begins, len(chunk.buf)))
            gone = np.repeat(np.maximum.reduceat(gone.astype(np.int8), begins) > 0, size)
        kept = chunk.buf[~gone].tobytes()
        at = chunk.off - np.concatenate([[0], np.cumsum(gone)])[chunk.off]
        text = chunk.batch.column("text")
        texts = [None if not ok else kept[a:b].decode() for ok, a, b in zip(text.is_valid().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
        k = chunk.batch.schema.get_field_index("text")
        return chunk.batch.set_column(k, "text", pa.array(texts, pa.string()))

    return ch.over_chunks(flagged(docs, length, shingle), cut, schema)
