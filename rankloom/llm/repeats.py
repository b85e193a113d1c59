"""Repeated windows across documents: sampled anchors find candidates, whole contexts decide.

Of each window of ``length`` units (words or bytes) one unit is its anchor: the leftmost smallest hash of the windows'
inner k-unit shingles. Equal windows have equal anchors at equal places, so windows without an anchor hash that occurs
twice are unique, and hashes of anchors, a fraction of all units, are all that must be exchanged to know which. The
windows of recurring anchors are then sent as contexts, text and all, to where equal anchors meet.

In a chunk, equal contexts are sent once, with the places of all of them: a passage that a third of all documents share
costs one context a chunk. No bucket ever holds more than a row per chunk of anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from . import textblocks as tb
from .chunks import NULL_ID, Chunk, bucket_bounds, expand, gather, pack, squeeze, unpack

_LOW = ~np.uint64(1)


@dataclass
class Units:
    """Units of a chunk in order: those of each row, and the byte range of each in ``buf``, in which contexts are contiguous."""

    buf: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None
    #: units of row r: from off[r] to off[r + 1]
    off: np.ndarray
    hashes: np.ndarray

    def rows(self, units: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, units, side="right") - 1

    def bounds(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges from unit ``first`` to unit ``last``; units are bytes where ``start`` is None."""
        return (first, last + 1) if self.start is None else (self.start[first], self.end[last])

    def starts(self, length: int) -> np.ndarray:
        """First units of all windows within a row."""
        n = int(self.off[-1]) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        good = np.ones(n, bool)
        for a, b in zip(np.maximum(self.off[:-1], self.off[1:] - length + 1).tolist(), self.off[1:].tolist(), strict=True):
            good[a:b] = False
        return np.flatnonzero(good)


def word_units(chunk: Chunk) -> Units:
    """Words between ASCII white space, in a buffer where one space parts them."""
    start, end, owner = tb.words(chunk.buf, chunk.off, tb.NOT_SPACE)
    size = end - start
    off = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    if not len(start):
        return Units(chunk.buf[:0], start, end, np.zeros(chunk.rows + 1, np.int64), np.zeros(0, np.uint64))
    take = np.arange(off[-1]) + np.repeat(start - off[:-1], size + 1)
    buf = chunk.buf[np.minimum(take, len(chunk.buf) - 1)]
    buf[off[1:] - 1] = 32
    start = off[:-1]
    rows = np.concatenate([[0], np.cumsum(tb.counts(owner, chunk.rows))])
    return Units(buf, start, start + size, rows, tb.byte_prefix(buf).slices(start, start + size))


def byte_units(chunk: Chunk) -> Units:
    return Units(chunk.buf, None, None, chunk.off, tb.byte_terms(chunk.buf))


def anchors(units: Units, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first start, last start, anchor hash with its low bit cleared)."""
    n = len(units.hashes)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64)
    h = tb.shingles(units.hashes, k)
    starts = units.starts(length)
    if not len(starts):
        return none, none, np.zeros(0, np.uint64)
    at = tb.minima(h, length - k + 1)[starts]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)], h[at[new]] & _LOW


def anchor_packets(cid: int, hashes: np.ndarray, buckets: int, ids: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Distinct hashes by bucket; the low bit is set if a hash occurs more than once here, or with ``ids``, those of the rows they come from, under more than one id."""
    values, at, count = np.unique(hashes, return_inverse=True, return_counts=True)
    again = count > 1
    if ids is not None:
        least, most = np.full(len(values), NULL_ID), np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(least, at, ids)
        np.maximum.at(most, at, ids)
        again &= least != most
    values = values | again.astype(np.uint64)
    bounds = bucket_bounds(values, buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, cid, values[bounds[b] : bounds[b + 1]].tobytes()


def recurring(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Replies: to each chunk, those of its hashes that occur again, in it or in another."""
    sizes = [len(b) // 8 for b in blobs]
    values = np.frombuffer(b"".join(blobs), np.uint64)
    own = np.repeat(np.arange(len(cids)), sizes)
    order = np.argsort(values & _LOW, kind="stable")
    v = values[order] & _LOW
    first = np.concatenate([[True], v[1:] != v[:-1]])
    group = np.cumsum(first) - 1
    many = np.bincount(group) > 1
    many |= np.bincount(group, weights=(values[order] & np.uint64(1)).astype(float)) > 0
    yield from split_by(own[order][many[group]], v[many[group]], cids)


def split_by(own: np.ndarray, values: np.ndarray, cids: list[int]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(own, kind="stable")
    own, values = own[order], values[order]
    bounds = np.searchsorted(own, np.arange(len(cids) + 1))
    for c in np.flatnonzero(np.diff(bounds)).tolist():
        yield cids[c], values[bounds[c] : bounds[c + 1]].tobytes()


def contexts(chunk: Chunk, units: Units, length: int, k: int, known: np.ndarray, buckets: int, batch: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Packets of the distinct contexts around the ``known`` (sorted) anchor hashes.

    An entity is a context in a row of the chunk with the smallest id that has it: its first place, its other places in
    that row (``same``), and, with the first entity of a context, the places in rows of larger ids (``later``).
    """
    first, last, h = anchors(units, length, k)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    hit = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
    if not len(hit):
        return
    first, last, h = first[hit], last[hit], h[hit]
    s, e = units.bounds(first, last + length - 1)
    row = units.rows(first)
    key = tb.byte_prefix(units.buf).slices(s, e)
    ids = chunk.ids[row]
    order = np.lexsort((first, row, ids, key, h))
    first, last, h, s, e, row, ids, key = (a[order] for a in (first, last, h, s, e, row, ids, key))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
    group = np.cumsum(new) - 1
    smallest = ids[np.flatnonzero(new)][group]
    later = ids > smallest
    entity_new = new | (~later & np.concatenate([[True], row[1:] != row[:-1]]))
    entity_of = np.cumsum(entity_new) - 1  # rows of larger ids follow the last entity of their context
    entity = np.flatnonzero(entity_new)
    n_later = np.bincount(entity_of[later], minlength=len(entity))
    n_same = np.bincount(entity_of, minlength=len(entity)) - 1 - n_later
    others = np.flatnonzero(~entity_new)  # same places come before later ones, entity by entity
    bounds = bucket_bounds(h[entity], buckets)
    o_bounds = np.concatenate([[0], np.cumsum(n_same + n_later)])
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi = bounds[b], bounds[b + 1]
        k_ = entity[lo:hi]
        # entities of one context follow each other, so its text is sent once
        fresh = new[k_]
        text, off = gather(units.buf, s[k_[fresh]], (e - s)[k_[fresh]])
        blob = pack(np.array([batch], np.int64), ids[k_], row[k_].astype(np.int32), first[k_].astype(np.int64), (last - first + 1)[k_].astype(np.int32), n_same[lo:hi].astype(np.int32), n_later[lo:hi].astype(np.int32), first[others[o_bounds[lo] : o_bounds[hi]]].astype(np.int64), fresh, np.diff(off).astype(np.int32), text, h[k_[fresh]])
        yield b, chunk.cid, squeeze(blob)


class Met:
    """The entities of a bucket from all chunks, with their distinct contexts."""

    def __init__(self, cids: list[int], blobs: list[bytes]) -> None:
        parts = [unpack(expand(b)) for b in blobs]
        n = [len(p[1]) for p in parts]
        self.cids, self.own = cids, np.repeat(np.arange(len(cids)), n)
        self.batch = np.repeat([int(p[0][0]) for p in parts], n)
        self.ids, self.row, self.first, self.windows, self.n_same, self.n_later, self.others = (np.concatenate([p[i] for p in parts]) for i in range(1, 8))
        sizes = np.concatenate([p[9] for p in parts]).astype(np.int64)
        buf = np.concatenate([p[10] for p in parts])
        text_of = np.cumsum(np.concatenate([p[8] for p in parts])) - 1  # each packet begins with a fresh context
        off = np.concatenate([[0], np.cumsum(sizes)])
        key = tb.byte_prefix(buf).slices(off[:-1], off[1:])
        check = tb.byte_prefix(buf, 1).slices(off[:-1], off[1:])
        order = np.lexsort((check, key))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])])
        distinct = np.empty(len(order), np.int64)
        distinct[order] = np.cumsum(new) - 1
        pick = order[new]
        #: distinct context of each entity; buffer, offsets and anchors of the distinct contexts
        self.context = distinct[text_of]
        self.buf, self.off = gather(buf, off[:-1][pick], sizes[pick])
        self.anchor = np.concatenate([p[11] for p in parts])[pick]

    def removals(self, earlier: np.ndarray, same_too: bool) -> Iterator[tuple[int, bytes]]:
        """Replies: starts of the windows to remove as packed [from, to) ranges.

        ``earlier``: of every window of every entity in order, whether an earlier one exists. Windows at ``later``
        places all go; those at ``same`` places go with ``same_too``, else they share their entity's fate.
        """
        w = self.windows.astype(np.int64)
        owner = np.repeat(np.arange(len(w)), w)
        begin = np.concatenate([[0], np.cumsum(w)])[:-1]
        place = np.arange(len(owner)) - begin[owner]
        starts = [(self.first[owner] + place)[earlier]]
        own = [self.own[owner][earlier]]
        ends = [starts[0] + 1]
        n_other = self.n_same + self.n_later
        entity = np.repeat(np.arange(len(w)), n_other)
        is_same = (np.arange(len(entity)) - np.repeat(np.concatenate([[0], np.cumsum(n_other)])[:-1], n_other)) < self.n_same[entity]
        whole = ~is_same | same_too
        starts.append(self.others[whole])
        ends.append(self.others[whole] + w[entity[whole]])
        own.append(self.own[entity[whole]])
        if not same_too and is_same.any():
            e = entity[is_same]
            pairs = np.repeat(np.arange(len(e)), w[e])
            inner = np.arange(len(pairs)) - np.repeat(np.concatenate([[0], np.cumsum(w[e])])[:-1], w[e])
            hit = earlier[begin[e[pairs]] + inner]
            s = (self.others[is_same][pairs] + inner)[hit]
            starts.append(s)
            ends.append(s + 1)
            own.append(self.own[e[pairs]][hit])
        a, b, own = np.concatenate(starts), np.concatenate(ends), np.concatenate(own)
        order = np.lexsort((a, own))
        a, b, own = a[order], b[order], own[order]
        if not len(a):
            return
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (a[1:] > b[:-1])])
        at = np.flatnonzero(new)
        ranges = np.stack([a[at], np.maximum.reduceat(b, at)], axis=1)
        bounds = np.searchsorted(own[at], np.arange(len(self.cids) + 1))
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            yield self.cids[c], ranges[bounds[c] : bounds[c + 1]].tobytes()


def removed_units(replies: list[bytes], n: int, length: int) -> np.ndarray:
    """Which of ``n`` units lie in a removed window."""
    edge = np.zeros(n + 1, np.int64)
    for blob in replies:
        ranges = np.frombuffer(blob, np.int64).reshape(-1, 2)
        np.add.at(edge, ranges[:, 0], 1)
        np.add.at(edge, ranges[:, 1] + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def classes_min(cls: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NULL_ID)
    np.minimum.at(out, cls, values)
    return out
