"""Vectorised words, shingles and hashes of many texts at a time, on their UTF-8 bytes.

A block is a byte buffer with the offsets of its texts, as Arrow keeps a string column. All functions work on a whole
block with numpy; nothing loops over words. Hashes are polynomials modulo 2**64 over a random table of byte values,
finished by a mixing function; the base is odd, so powers have inverses and any substring's hash is a difference of
two prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BLOCK = 1 << 14
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)

IDENTITY = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes unchanged.
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: Bytes that aren't ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Digits, lower-case letters and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    shape, h = h.shape, np.ascontiguousarray(h).ravel()
    out = np.empty_like(h)
    spare = np.empty(min(len(h), _BLOCK), _U)
    for lo in range(0, len(h), _BLOCK):  # blocks that stay in a core's cache
        x = out[lo : lo + _BLOCK]
        t = spare[: len(x)]
        np.right_shift(h[lo : lo + _BLOCK], _U(30), out=t)
        np.bitwise_xor(h[lo : lo + _BLOCK], t, out=x)
        x *= _U(0xBF58476D1CE4E5B9)
        np.right_shift(x, _U(27), out=t)
        x ^= t
        x *= _U(0x94D049BB133111EB)
        np.right_shift(x, _U(31), out=t)
        x ^= t
    return out.reshape(shape)


def arrow_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets) of a string or binary column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Prefix:
    """Prefix sums from which the hash of any slice of ``values`` (uint64 terms) comes in constant time."""

    def __init__(self, terms: np.ndarray) -> None:
        up, self.down = _powers(len(terms) + 1)
        self.sums = np.empty(len(terms) + 1, _U)
        self.sums[0] = 0
        np.multiply(terms, up[:-1], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


def byte_terms(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    return _TABLES[seed][buf]


def byte_prefix(buf: np.ndarray, seed: int = 0) -> Prefix:
    return Prefix(byte_terms(buf, seed))


def words(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word: maximal runs of bytes in ``member`` within a text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    edges = off[1:-1][(off[1:-1] < len(buf))]
    before[edges] = False
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = off[1:-1]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def counts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def windows(h: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of ``k`` consecutive words of one text."""
    if len(h) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(owner[: len(h) - k + 1] == owner[k - 1 :])


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on, whatever texts they're in; len(h) - k + 1 values."""
    if len(h) < k:
        return np.zeros(0, _U)
    prefix = Prefix(h)
    d = prefix.sums[k:] - prefix.sums[:-k]
    d *= prefix.down[: len(d)]
    d += _U(k)
    return mix(d)


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of each ``w`` consecutive hashes, the leftmost of equal ones; compares their upper halves."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(h) >= 1 << 32:
        raise ValueError("a block must have fewer than 2**32 places")
    out = np.empty(n, np.int64)
    for lo in range(0, n, _BLOCK):
        key = h[lo : lo + _BLOCK + w - 1] & _U(0xFFFFFFFF00000000)
        key |= np.arange(lo, lo + len(key), dtype=_U)
        width = 1
        while width * 2 <= w:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        if rest := w - width:
            key = np.minimum(key[: len(key) - rest], key[rest:])
        key &= _U(0xFFFFFFFF)
        out[lo : lo + len(key)] = key
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``length`` from some start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
