"""Best-fit packing of tokenised documents into fixed-length sequences, with certified bin counts.

Documents are tokenised once; a document longer than a sequence is cut into full pieces and one shorter first piece.
Full pieces are sequences by themselves. The others are dealt to groups of bounded size, packed by best-fit decreasing
in each group, and each group's bin count is certified by the largest of a family of dual-feasible-function lower
bounds. Groups with a gap put the pieces of their wasteful bins into an exchange: these are dealt anew, each new group
taking pieces of many old ones, and packed again; a round is kept only if it saves sequences.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as separate documents; ties in
length keep input order within a group; a null ``doc_id`` is carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import arrow_rows, table

CAPACITY = 1024
END = 2
#: Most pieces that one task packs at a time.
GROUP_PIECES = 1 << 16
#: Bits of a sequence's number that count bins in a group, and groups in a level.
BIN_BITS, GROUP_BITS = 18, 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, exactly those of the tokenizer file.

    The byte-level pre-tokenizer only ever joins a space to what follows it, so a text falls apart before each space
    and the parts can be remembered. Texts where that doesn't hold (a space between white space, or after some at the end), with special tokens or with characters outside Latin, where two libraries' Unicode tables may differ, go to
    the tokenizer whole. Parts not yet seen are encoded from the rank file of the same vocabulary.
    """

    #: A space amid white space: what ends up with it depends on more than the part it begins.
    _AMID = re.compile(r" (?<=\s )(?:\s|\Z)")
    _FAR = re.compile("[^\x00-\u024f]")
    #: Parts remembered by a worker before it starts anew.
    PARTS = 600_000

    def __init__(self, tokenizer: str, ranks: str, pattern: str) -> None:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        assert sys.byteorder == "little"

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                ids = self[part] = array("I", encode(" " + part)).tobytes()
                return ids

        self.parts = Parts()
        self.encode = encode

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")  # quick to tell for nearly all texts
        except UnicodeEncodeError:
            if self._FAR.search(text):
                return False
        return "<|endoftext|>" not in text and not self._AMID.search(text)

    def ids(self, text: str) -> bytes:
        if not self._plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.parts) > self.PARTS:
            self.parts.clear()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.parts.__getitem__, rest))


_ENCODERS: dict[tuple, Encoder] = {}


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``."""
    arrow_rows(docs.sparkSession, 1000)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, ranks, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*key)
        encoder = _ENCODERS[key]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin, offset) of each length, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    mask, n = 0, 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room := room - size:
            free[room].append(b)
            mask |= 1 << room
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of two families of dual feasible functions, the identity among them.

    The first drops sizes under a threshold and rounds sizes over its complement up to a whole bin; the second rounds
    sizes down to multiples of 1/k of a bin unless they are such multiples of 1/(k+1). Exact in integers.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1)
    best = 0
    plain = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    for threshold in range(0, capacity // 2 + 1):
        f = np.where(size > capacity - threshold, capacity, np.where(size < threshold, 0, size))
        best = max(best, -(-int((f * plain).sum()) // capacity))
    for k in range(1, 101):
        q, r = np.divmod(size * (k + 1), capacity)
        # in units of capacity * k: multiples of 1/(k+1) keep their size, others take q/k of a bin
        f = np.where(r == 0, size * k, q * capacity)
        best = max(best, -(-int((f * count).sum()) // (capacity * k)))
    return best


def _pack(items: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Items with sequence_id, offset, waste of their bin and gap of their group, dealt evenly to ``groups`` groups."""
    columns = [f.split()[0] for f in PIECES.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets, n = best_fit(lengths, capacity)
        used = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        out = pdf[columns].copy()
        out["sequence_id"] = (((level << GROUP_BITS) + int(key[0])) << BIN_BITS) + 2 * bins + 1
        out["offset"], out["waste"] = offsets, capacity - used[bins]
        out["gap"] = n - lower_bound(lengths, capacity)
        return out

    dealt = items.select(*columns, F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("g"))
    return table(dealt.groupBy("g").applyInPandas(run, f"{PIECES}, sequence_id long, offset long, waste long, gap long"), f"packed-{level}")


def pack(found: DataFrame, capacity: int = CAPACITY, rounds: int | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``found`` (materialised pieces) with sequence_id and offset. Groups with gaps exchange pieces until that saves no sequence, or for ``rounds`` rounds."""
    whole = found.where(F.col("length") == capacity)
    out = [whole.select("*", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items = found.where(F.col("length") < capacity)
    n = items.count()
    if not n:
        return out[0]
    packed = _pack(items, max(1, -(-n // group_pieces)), 0, capacity)
    for level in itertools.count(1):
        if rounds is not None and level > rounds:
            break
        open_ = packed.where("gap > 0 and waste > 0")
        n, groups, bins = open_.select(F.count(F.lit(1)), F.count_distinct(F.shiftright("sequence_id", BIN_BITS)), F.count_distinct("sequence_id")).first()
        if groups < 2:
            break
        again = _pack(open_, max(1, -(-n // group_pieces)), level, capacity)
        if (now := again.agg(F.count_distinct("sequence_id")).first()[0]) >= bins:
            break
        out.append(packed.where("gap <= 0 or waste <= 0"))
        packed = again
    out.append(packed)
    result = None
    for part in out:
        part = part.select(*[f.split()[0] for f in PIECES.split(", ")], "sequence_id", "offset")
        result = part if result is None else result.unionByName(part)
    return result


def best_fit_pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text, ...) with the sequence and offset of each."""
    return pack(table(pieces(docs, tokenizer, ranks, pattern, capacity), "pieces"), capacity)
