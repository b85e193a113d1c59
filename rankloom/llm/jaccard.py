"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word n-grams; two documents link when ``100 * intersection >= percent * union``.
Sets are sorted into bands of nearly equal size. Sets that link and whose larger one lies in a band differ in at most k
elements, k following from the band's upper size. The domain of n-grams is cut by a hash into n1 partitions, more than
k / 2, so some partitions hold at most one difference; each is cut again into three, and each signature leaves out one
of the three: two such sets share a signature in every such partition. A set signs for its own band and for higher ones
that hold sets it could link with. n1 has a little slack, so sets can leave out signatures of no elements as long as
they have few; sets with many emit them all.

Equal sets are one node from the start. Where a signature meets, its nodes are tied as a star to the smallest one, never
pair by pair. Distinct star edges are verified exactly on the full sets; components follow from the verified links. Only
signatures whose nodes still lie in different components go on: what is left of their pairs, without the centre, is
verified too. Every pair that shares a signature is so either verified or already connected; no candidate is dropped.

Defined cases: a text with fewer words than n is one n-gram, the whole sequence; texts without words (null too) are
empty sets, linked with nothing; repeated rows are equal sets; the component of rows with null ids takes the smallest
id there is, null if none; an empty table gives an empty result; other columns ride along in ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import chunks as ch, textblocks as tb
from .chunks import Chunk
from .shared import remove, table as written

NGRAM = 4
PERCENT = 85
#: A band's largest size over the one below it.
RATIO = 1.4

_U = np.uint64
_K1, _K2, _K3 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)

MEMBERS = "cid long, row int, doc_id long, n long, node long"
MEETINGS = "sig long, center long, node long"
OUTLINES = "node long, n long, sketch binary"
GRAMS = "node long, grams binary"
#: Nodes, and n-grams of their sets, in a block; a task compares two blocks at a time.
BLOCK, BLOCK_GRAMS = 2048, 1 << 21
#: Bytes of sets that a round of such tasks shuffles: these, or as many as the texts have.
ROUND_BYTES = 64 << 20


def table(df: DataFrame, name: str) -> DataFrame:
    """A written table; what planning and running it left on the driver goes at once. A join takes some fifty of these, and
    a driver that collects only when its heap is full has touched all of it by then."""
    held = written(df, name)
    remove()
    return held


def band_tops(largest: int) -> list[int]:
    tops, top = [1], 1
    while top < largest:
        top = max(top + 1, int(top * RATIO))
        tops.append(top)
    return tops


def sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of each row, ascending within a row; offsets by row; hash of each row's whole set)."""
    start, end, owner = tb.words(buf := tb.LOWER[chunk.buf], chunk.off, tb.NOT_SPACE)
    if not len(start):
        return np.zeros(0, _U), np.zeros(chunk.rows + 1, np.int64), np.zeros(chunk.rows, _U)
    h = tb.byte_prefix(buf).slices(start, end)
    count = tb.counts(owner, chunk.rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    grams, at = tb.shingles(h, n), np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, 0))])
    short = np.flatnonzero((count > 0) & (count < n))
    whole = dict(zip(short.tolist(), tb.Prefix(h).slices(first[short], first[short] + count[short]), strict=True))
    parts, sizes = [], np.zeros(chunk.rows, np.int64)
    for k in range(chunk.rows):
        if count[k] >= n:
            g = np.sort(grams[first[k] : first[k] + count[k] - n + 1])
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
        elif count[k]:
            g = np.array([whole[k]], _U)
        else:
            continue
        parts.append(g)
        sizes[k] = len(g)
    off = np.concatenate([[0], np.cumsum(sizes)])
    elements = np.concatenate(parts)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(tb.mix(elements ^ _K3))])
    return elements, off, tb.mix((total[off[1:]] - total[off[:-1]]) * _K1 + sizes.astype(_U))


def signatures(elements: np.ndarray, off: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the given rows' sets."""
    size = np.diff(off)
    tops = np.array(band_tops(int(size.max()) * 100 // percent + 1 if len(size) else 1))
    out_s, out_r = [], []
    for j, top in enumerate(tops.tolist()):
        low = int(tops[j - 1]) + 1 if j else 1
        # in the band itself, or smaller but able to link with the smallest set of it
        mine = rows[(size[rows] <= top) & (100 * size[rows] >= percent * low) & (size[rows] > 0)]
        k = 2 * top * (100 - percent) // (100 + percent)
        if not len(mine) or k == 0:
            continue
        slack = min(2, k // 16)
        n1 = k // 2 + 1 + slack
        e, at = ch.gather(elements, off[mine], size[mine])
        owner = np.repeat(np.arange(len(mine)), size[mine])
        x = tb.mix(e ^ _K2)
        part = ((x >> _U(32)) * _U(n1) >> _U(32)).astype(np.int64)
        cell = (owner * n1 + part) * 3 + ((x & _U(0xFFFFFF)) % _U(3)).astype(np.int64)
        total = np.zeros(len(mine) * n1 * 3, _U)
        np.add.at(total, cell, tb.mix(e + _K1))
        total = total.reshape(len(mine), n1, 3)
        empty = np.bincount(cell, minlength=total.size).reshape(total.shape) == 0
        for_cell = tb.mix((np.arange(n1 * 3, dtype=_U) + _U(1)) * _K3 + _U(j)).reshape(1, n1, 3)
        sig = np.empty_like(total)
        none = np.empty(total.shape, bool)
        for q in range(3):
            a, b = (q + 1) % 3, (q + 2) % 3
            sig[:, :, q] = tb.mix(total[:, :, a] * _K1 + total[:, :, b] * _K2 + for_cell[:, :, q])
            none[:, :, q] = empty[:, :, a] & empty[:, :, b]
        emit = ~none | (none.any(axis=2).sum(axis=1) > slack)[:, None, None]
        out_s.append(sig[emit])
        out_r.append(np.broadcast_to(mine[:, None, None], emit.shape)[emit])
    if not out_s:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_r)


def _meet(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """The stars of a bucket: (signature, centre, node) for every node but the centre."""
    parts = [ch.unpack(b) for b in blobs]
    sig = (np.concatenate([p[0] for p in parts]).astype(_U) << _U(16)) | np.concatenate([p[1] for p in parts]).astype(_U)
    node = np.concatenate([p[2] for p in parts])
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    again = np.concatenate([[False], (node[1:] == node[:-1]) & ~new[1:]])
    sig, node, new = sig[~again], node[~again], new[~again]
    center = node[np.flatnonzero(new)][np.cumsum(new) - 1]
    tied = ~new
    yield from zip(sig[tied].view(np.int64).tolist(), center[tied].view(np.int64).tolist(), node[tied].view(np.int64).tolist(), strict=True)


def sketch(grams: np.ndarray) -> np.ndarray:
    """How many n-grams fall in each of equal ranges of hashes, some eight to a range, 255 at most: sets without relation already differ in more than may link."""
    bits = max(4, int(len(grams)).bit_length() - 3)
    return np.minimum(np.bincount((grams >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the elements in which two sets differ, from their sketches."""
    x, y = (v.astype(np.int64) for v in (x, y))
    if max(x.max(initial=0), y.max(initial=0)) == 255:
        return 0
    while len(x) != len(y):
        x, y = (x.reshape(-1, 2).sum(axis=1), y) if len(x) > len(y) else (x, y.reshape(-1, 2).sum(axis=1))
    return int(np.abs(x - y).sum())


def _possible(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to link: a small part of what full sets weigh decides about most."""
    a, b = (held.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                (100 + percent) * least_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= (100 - percent) * n
                for n, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)
            ]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    met = pairs.join(b.drop("sb"), "b").join(a.drop("sa"), "a").where(near).select("a", "b", (F.col("na") + F.col("nb")).alias("n"))
    met = met.join(b.select("b", "sb"), "b").join(a.select("a", "sa"), "a").select("a", "b", "n", "sa", "sb")
    return met.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, holders: Holders, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Sketches are fetched of all their nodes, whole sets only of those that these leave."""
    outlines = holders.fetch(_nodes(pairs), lambda node, grams: (node, len(grams), sketch(grams).tobytes()), OUTLINES)
    near = table(_possible(pairs, outlines, percent), "possible")
    remove(outlines)
    held = holders.fetch(_nodes(near), lambda node, grams: (node, grams.tobytes()), GRAMS)
    a, b = (held.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            linked = []
            for p, ga, gb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if p != last:
                    last, x = p, np.frombuffer(ga.as_py(), _U)
                y = np.frombuffer(gb.as_buffer(), _U)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    met = near.join(b, "b").join(a, "a").select("a", "b", "ga", "gb")
    links = table(met.mapInArrow(run, "a long, b long"), "verified")
    remove(near, held)
    return links


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


@dataclass
class Holders:
    """Where the sets are: the chunks, and one row of them for each node."""

    chunks: DataFrame
    members: DataFrame
    n: int

    def ask(self, nodes: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str, told: DataFrame | None = None) -> DataFrame:
        """``fn`` of (chunk id, nodes, their sets one after another, offsets) for each chunk that holds some of ``nodes``, and of a list of the packets in ``told`` (cid, blob) for it."""
        at = self.members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("cid", "row")).alias("at"))
        asked = at.groupBy("at.cid").agg(F.collect_list("at.row").alias("rows")).select("cid", F.array_join("rows", ",").cast("binary").alias("blob"))
        n, more = self.n, told is not None

        def give(chunk: Chunk, replies: list[bytes]) -> Iterator[tuple]:
            packets = [blob for blob in replies if not blob[:1].isdigit()]
            rows = np.array(sorted(int(r) for blob in replies if blob[:1].isdigit() for r in blob.split(b",")), np.int64)
            elements, off, whole = sets(chunk.some(rows), n)
            yield from fn(chunk.cid, whole.view(np.int64), elements, off, *[packets] * more)

        return ch.over_chunks(ch.with_replies(self.chunks, asked.unionByName(told) if more else asked, "inner"), give, schema)

    def fetch(self, nodes: DataFrame, fn: Callable[[int, np.ndarray], tuple], schema: str) -> DataFrame:
        """A written table of ``fn`` of each node and its set."""

        def each(_: int, node: np.ndarray, elements: np.ndarray, off: np.ndarray) -> Iterator[tuple]:
            for k, name in enumerate(node.tolist()):
                yield fn(name, elements[off[k] : off[k + 1]])

        return table(self.ask(nodes, each, schema), "sets")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the component's smallest node. Labels flow to neighbours and jump."""
    both = table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    held = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        labels = held.select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        flown = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = table(flown.join(jump, "to").select("node", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("label")).alias("moved")), "labels")
        moved = step.where("moved").limit(1).count()
        remove(held)  # with what the round broadcast
        held = step
        if not moved:
            remove(both)
            return held.select("node", "label")


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after further links: whole components are one node of the links that join them, so only those are walked."""
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
    between = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    roots = components(between)
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return moved.unionByName(roots.join(labels, "node", "left_anti"))


def join(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The chunk table of ``docs``, and (cid, row, doc_id, n, label) of every row: equal labels are one component, null is alone."""
    chunks, size = ch.store(docs, "jaccard")
    buckets = ch.bucket_count(size)

    def describe(chunk: Chunk, _: list[bytes]) -> pa.RecordBatch:
        _, off, whole = sets(chunk, n)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(chunk.rows, chunk.cid)), pa.array(np.arange(chunk.rows, dtype=np.int32)), chunk.batch.column("doc_id"), pa.array(np.diff(off)), pa.array(whole.view(np.int64))],
            names=["cid", "row", "doc_id", "n", "node"],
        )

    def sign(chunk: Chunk, _: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        elements, off, whole = sets(chunk, n)
        _, rows = np.unique(whole, return_index=True)
        sig, row = signatures(elements, off, rows, percent)
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], whole[row[order]]
        bounds = ch.bucket_bounds(sig, buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            s = sig[bounds[b] : bounds[b + 1]] >> _U(16)  # 48 bits are enough to meet; pairs are verified
            yield b, chunk.cid, ch.pack((s >> _U(16)).astype(np.uint32), (s & _U(0xFFFF)).astype(np.uint16), node[bounds[b] : bounds[b + 1]])

    members = table(ch.over_chunks(chunks, describe, MEMBERS), "members")
    met = table(ch.over_buckets(ch.over_chunks(chunks, sign, ch.PACKETS), _meet, MEETINGS), "meetings")
    remove()
    holders = Holders(chunks, members, n)
    stars = table(met.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = _linked(stars, holders, percent)
    labels = components(links)
    more = _rest(met, labels, holders, percent, buckets, max(size, ROUND_BYTES))
    if more.limit(1).count():
        labels = _merged(labels, more)
    found = table(members.join(labels, "node", "left").select("cid", "row", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label")), "components")
    remove(members, met, stars, more)
    return chunks, found


def _alone(nodes: DataFrame, holders: Holders, buckets: int) -> DataFrame:
    """(node, alone): how many n-grams of each of ``nodes`` no other of them has; a collision of the hashes that tell makes it less.

    An n-gram that several nodes of a chunk have is sent once, as nobody's.
    """

    def send(cid: int, node: np.ndarray, elements: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        own = np.repeat(np.arange(len(node), dtype=np.uint16), np.diff(off))
        order = np.argsort(elements, kind="stable")
        grams, own = elements[order], own[order]
        first = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
        lone = first & np.append(first[1:], True)[: len(first)]
        grams, own = grams[first], np.where(lone, own, len(node))[first].astype(np.uint16)
        bounds = ch.bucket_bounds(grams, buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[b], bounds[b + 1])
            used, at = np.unique(own[part], return_inverse=True)
            # the bucket stands for the upper bits
            low = (grams[part] * _U(buckets) >> _U(32) if buckets < 1 << 31 else grams[part]).astype(np.uint32)
            yield b, cid, ch.pack(low, at.astype(np.uint16), np.append(node, 0)[used], used < len(node))

    def count(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [ch.unpack(b) for b in blobs]
        grams = np.concatenate([p[0] for p in parts])
        node, lone = (np.concatenate([p[k][p[1]] for p in parts]) for k in (2, 3))
        own = np.repeat(np.arange(len(cids)), [len(p[0]) for p in parts])
        order = np.argsort(grams, kind="stable")
        grams, node, lone, own = grams[order], node[order], lone[order], own[order]
        first = np.concatenate([[True], grams[1:] != grams[:-1]])
        only = np.flatnonzero(first & np.append(first[1:], True) & lone)
        for c in np.unique(own[only]).tolist():
            yield cids[c], ch.pack(*np.unique(node[only[own[only] == c]], return_counts=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for replies in batch.column(0).to_pylist():
                parts = [ch.unpack(b) for b in replies]
                node, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], names=["node", "alone"])

    counted = ch.over_buckets(holders.ask(nodes, send, ch.PACKETS), count, ch.REPLIES)
    return counted.groupBy("cid").agg(F.collect_list("blob").alias("replies")).select("replies").mapInArrow(add, "node long, alone long")


def _rare(nodes: DataFrame, holders: Holders, percent: int, buckets: int) -> DataFrame:
    """(sig, node): the n-grams of each of ``nodes`` by which it can meet those it links with.

    Sets that link have ``percent`` of the n-grams of each in common, at least. So in any order of n-grams, the first ones
    of either, one more than it may have without the other, hold one that both have. In the order of how many of ``nodes``
    have them, rarest first, few sets meet by chance. N-grams that one node alone has are left out.
    """

    def send(cid: int, node: np.ndarray, elements: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        grams, count = np.unique(elements, return_counts=True)
        bounds = ch.bucket_bounds(grams, buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[b], bounds[b + 1])
            yield b, cid, ch.pack(grams[part], count[part].astype(np.uint16))

    def add(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [ch.unpack(b) for b in blobs]
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        for cid, (own, _) in zip(cids, parts, strict=True):
            held = total[np.searchsorted(grams, own)]
            yield cid, ch.pack(own[held > 1], held[held > 1])

    def first(cid: int, node: np.ndarray, elements: np.ndarray, off: np.ndarray, told: list[bytes]) -> Iterator[tuple[int, int]]:
        parts = [ch.unpack(b) for b in told]
        grams, total = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        held = np.ones(len(elements), np.int64)
        if len(grams):
            order = np.argsort(grams)
            at = order[np.minimum(np.searchsorted(grams, elements, sorter=order), len(grams) - 1)]
            held[grams[at] == elements] = total[at][grams[at] == elements]
        size = np.diff(off)
        own = np.repeat(np.arange(len(node)), size)
        order = np.lexsort((elements, held, own))
        place = np.arange(len(elements)) - off[own]
        take = order[place < (size - -(-percent * size // 100) + 1)[own]]
        take = take[held[take] > 1]
        yield from zip(elements[take].view(np.int64).tolist(), node[own[take]].tolist(), strict=True)

    told = ch.over_buckets(holders.ask(nodes, send, ch.PACKETS), add, ch.REPLIES)
    return holders.ask(nodes, first, "sig long, node long", told)


def _open(labelled: DataFrame) -> DataFrame:
    """The rows of signatures whose nodes are in different components."""
    spread = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return labelled.join(spread.where("lo <> hi").select("sig"), "sig", "left_semi")


def _rest(met: DataFrame, labels: DataFrame, holders: Holders, percent: int, buckets: int, budget: int) -> DataFrame:
    """Links, as many as it takes to connect what they connect, among pairs of one signature that are still in different components.

    What a node shares with another of these is at most its n-grams that aren't its alone: nodes with too many of their
    own are done. The others meet again by their rarest n-grams. Those of different components that do are dealt into
    blocks, and blocks that such an n-gram ties are compared two at a time, every set of one with every set of the other,
    so many pairs of blocks in a round as their sets weigh no more than ``budget`` bytes. What leaves a task is a forest of links.
    """
    of = labels.select("node", "label")
    labelled = met.select("sig", F.col("node")).unionByName(met.select("sig", F.col("center").alias("node")).distinct())
    labelled = labelled.join(of, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    wide = table(_open(labelled), "open")
    nodes = table(wide.select("node").distinct(), "nodes")
    sizes = holders.members.join(nodes, "node", "left_semi").select("node", "n").distinct()
    share = sizes.join(_alone(nodes, holders, buckets), "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    can = table(share.where(F.col("most") * 100 >= F.col("n") * percent).select("node", "n"), "can")
    left = table(_open(wide.join(can, "node")).select("node", "label", "n").distinct(), "open")  # without the others, most signatures are settled
    remove(wide, nodes, can)
    tied = table(_open(_rare(left.select("node"), holders, percent, buckets).join(left, "node")), "rare")
    remove(left)
    blocks, together = _blocks(tied)
    held = holders.fetch(blocks.select("node"), lambda node, grams: (node, grams.tobytes()), GRAMS)
    sides = together.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    weight = blocks.groupBy("block").agg(F.sum("n").alias("n"))
    rounds = max(1, -(-8 * (sides.join(weight, "block").agg(F.sum("n")).first()[0] or 0) // budget))
    parts = []
    for k in range(rounds):  # what a round shuffles goes before the next
        now = sides.where(F.pmod(F.xxhash64("x", "y"), F.lit(rounds)) == k)
        groups = now.join(blocks, "block").join(held, "node").select("x", "y", "block", "node", "label", "grams")
        parts.append(table(groups.repartition("x", "y").sortWithinPartitions("x", "y", "block").mapInArrow(_compared(percent), "a long, b long"), "verified"))
        remove()
    links = parts[0]
    if rounds > 1:
        links = table(reduce(DataFrame.unionByName, parts), "verified")
        remove(*parts)
    remove(tied, blocks, together, held)
    return links


def _blocks(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label, n, block), and (x, y): the pairs of blocks, x = y too, that a signature asks to compare.

    Nodes that signatures tie together, at once or through others, are one block if they are few enough. Else they are
    dealt by the smallest signature each has, so that those of one signature stay close, and those of a large one by
    themselves.
    """
    star = left.groupBy("sig").agg(F.min("node").alias("a"))
    tied = table(left.join(star, "sig").select("a", F.col("node").alias("b")).where("a <> b").distinct(), "tied")
    coarse = components(tied).withColumnRenamed("label", "coarse")
    homes = left.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("sig").alias("home"))
    of_home = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    placed = homes.join(of_home, "home").join(coarse, "node")
    of_coarse = placed.groupBy("coarse").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("parts"))
    part = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("node"), "salts")), "parts")
    blocks = table(placed.join(of_coarse, "coarse").select("node", "label", "n", F.xxhash64("coarse", part).alias("block")), "blocks")
    met = left.select("sig", "node").join(blocks.select("node", "block"), "node").groupBy("sig").agg(F.collect_set("block").alias("bs"))
    pairs = met.select("bs", F.explode("bs").alias("x")).select("x", F.explode("bs").alias("y")).where("x <= y").distinct()
    return blocks, table(pairs, "together")


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets ``x`` has in common with each of ``y``: a product of indicator matrices, some columns at a time."""
    sets_ = [*x, *y]
    grams, own = np.concatenate(sets_), np.repeat(np.arange(len(sets_), dtype=np.int32), [len(v) for v in sets_])
    order = np.argsort(grams, kind="stable")
    grams, own = grams[order], own[order]
    column = np.cumsum(np.concatenate([[True], grams[1:] != grams[:-1]])) - 1
    sides = [np.bincount(column, weights=w) > 0 for w in (own < len(x), own >= len(x))]
    both = (sides[0] & sides[1])[column]  # others add nothing
    own, column = own[both], column[both]
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
    out = np.zeros((len(x), len(y)), np.int64)
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + width + 1, width))
    for k in range(len(cuts) - 1):
        m = np.zeros((len(sets_), width), np.float32)
        part = slice(cuts[k], cuts[k + 1])
        m[own[part], column[part] - k * width] = 1
        out += (m[: len(x)] @ m[len(x) :].T).astype(np.int64)
    return out


def _compared(percent: int):
    """Of each group of rows (x, y, block, node, label, grams): a forest of links between nodes of different labels."""

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        x, y, block, node, label, grams = zip(*group, strict=True)
        own = [k for k, b in enumerate(block) if b == x[0]]
        other = own if x[0] == y[0] else [k for k, b in enumerate(block) if b == y[0]]
        sets_ = [np.frombuffer(g, _U) for g in grams]
        size = np.array([len(g) for g in sets_])
        common = shared([sets_[k] for k in own], [sets_[k] for k in other])
        linked = 100 * common >= percent * (size[own][:, None] + size[other][None, :] - common)
        part = np.unique(label, return_inverse=True)[1]
        other = np.array(other)
        for i, k in enumerate(own):
            for j in other[linked[i]][np.unique(part[other[linked[i]]], return_index=True)[1]].tolist():
                if part[j] != part[k]:
                    part[part == part[j]] = part[k]
                    yield min(node[k], node[j]), max(node[k], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != now and held:
                    yield ch._rows("a long, b long", list(links(held)))
                    held = []
                now = row[:2]
                held.append(row)
        if held:
            yield ch._rows("a long, b long", list(links(held)))

    return run


def digest(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    chunks, found = join(docs, n, percent)
    remove(chunks)
    least = found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return found.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id; empty sets all stay."""
    schema = docs.withColumns({"doc_id": docs["doc_id"].cast("long"), "text": docs["text"].cast("string")}).schema
    chunks, found = join(docs, n, percent)
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid", "row")).alias("at"))
    kept = first.select("at.cid", "at.row").unionByName(found.where("label is null").select("cid", "row"))
    asked = kept.groupBy("cid").agg(F.collect_list("row").alias("rows")).select("cid", F.array_join("rows", ",").cast("binary").alias("blob"))

    def keep(chunk: Chunk, replies: list[bytes]) -> pa.RecordBatch:
        rows = sorted(int(r) for blob in replies for r in blob.split(b","))
        return chunk.batch.take(pa.array(rows, pa.int64()))

    return ch.over_chunks(ch.with_replies(chunks, asked, "inner"), keep, schema)
