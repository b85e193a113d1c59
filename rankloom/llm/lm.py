"""A gated recurrent language model that scores whole documents.

Counts: the words of every training document are counted over the whole corpus, in packets of distinct words a chunk.
They give the unigram base, and the vocabulary: the commonest words and the end token, all others share one entry.

Model: a gated recurrent unit over the vocabulary, with the output softmax factored into classes, narrow ones for frequent
words; a word outside it is the shared entry's probability times its smoothed share among such words.
It is trained in numpy by truncated backpropagation: batches of documents are walked in windows, the state is carried
from window to window and gradients stop at window borders. Training is spread: in each round every task improves the
common parameters on its own training documents of that round (each training document is in exactly one round), and the
results are averaged, weighted by tokens, in a tree of which the driver sees the last few.

Scoring walks many documents side by side, the state carried over window borders, to the end of each document.

Defined cases: a null or empty text is the end token alone; rows are scored one by one, so repeated rows and ties get
equal scores; a null id is in no fold and so is scored but not held out, nor learnt from; without training documents all
counts are 0 and the model is the untrained one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import chunks as ch, textblocks as tb
from .chunks import Chunk
from .shared import remove, table

VOCABULARY = 4096
HIDDEN = 24
WINDOW = 32
ROUNDS = 3
#: Documents walked side by side in scoring and in training.
SCORE_ROWS, TRAIN_ROWS = 2048, 256
#: How fast classes widen.
WIDTH = 2.5
#: Networks that are averaged at a time.
FAN_IN = 16
#: Tokens whose output is computed at a time: what that takes stays in a core's cache.
BLOCK = 4096
FOLDS, HELD_OUT = 5, 1

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_U = np.uint64


def held_out_rows(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(held out, training) of each row by crc32 of its id as text."""
    fold = np.array([-1 if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids.to_pylist()])
    return fold == HELD_OUT, (fold >= 0) & (fold != HELD_OUT)


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the chunk's words, their rows, words a row)."""
    buf = tb.LOWER[chunk.buf]
    start, end, owner = tb.words(buf, chunk.off, tb.NOT_SPACE)
    h = tb.byte_prefix(buf).slices(start, end) if len(start) else np.zeros(0, _U)
    return h, owner, tb.counts(owner, chunk.rows)


def _sum_counts(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(v, return_inverse=True)
    return values, np.bincount(at, weights=n, minlength=len(values)).astype(np.int64)


@dataclass
class Counts:
    """Corpus totals, and the commonest words' hashes with their counts, commonest first."""

    tokens: int
    distinct: int
    ends: int
    words: np.ndarray
    counts: np.ndarray


def count(chunks: DataFrame, buckets: int, vocabulary: int) -> tuple[Counts, DataFrame, DataFrame]:
    """Totals of the training documents, the written packets, and replies that tell each chunk the counts of all its distinct words."""

    def send(chunk: Chunk, _: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        h, owner, n = tokens(chunk)
        train = held_out_rows(chunk.batch.column("doc_id"))[1]
        values, at = np.unique(h, return_inverse=True)
        mine = np.bincount(at[train[owner]], minlength=len(values)).astype(np.int32) if len(values) else np.zeros(0, np.int32)
        bounds = ch.bucket_bounds(values, buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            yield b, chunk.cid, ch.pack(values[bounds[b] : bounds[b + 1]], mine[bounds[b] : bounds[b + 1]])
        yield -1, chunk.cid, ch.pack(np.array([int(train.sum())]))

    sent = table(ch.over_chunks(chunks, send, ch.PACKETS), "words")

    def totals(bucket: int, _: list[int], blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        v, n = (np.concatenate(a) for a in zip(*(ch.unpack(b) for b in blobs), strict=True))
        v, n = _sum_counts(v, n)
        top = np.lexsort((v, -n))[:vocabulary]
        top = top[n[top] > 0]
        yield int(n.sum()), int((n > 0).sum()), ch.pack(v[top], n[top])

    ends = sent.where("bucket = -1").select(F.col("cid"), "blob")
    n_ends = sum(int(ch.unpack(r["blob"])[0][0]) for r in ends.toLocalIterator())
    found = ch.over_buckets(sent.where("bucket >= 0"), totals, "tokens long, words long, blob binary")
    n_tokens, n_words, best = 0, 0, (np.zeros(0, _U), np.zeros(0, np.int64))
    for r in table(found, "totals").toLocalIterator():
        n_tokens, n_words = n_tokens + r["tokens"], n_words + r["words"]
        v, n = ch.unpack(r["blob"])
        v, n = np.concatenate([best[0], v]), np.concatenate([best[1], n])
        top = np.lexsort((v, -n))[:vocabulary]
        best = v[top], n[top]

    def reply(bucket: int, cids: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        parts = [ch.unpack(b) for b in blobs]
        v, n = _sum_counts(*(np.concatenate(a) for a in zip(*parts, strict=True)))
        for cid, (own, _) in zip(cids, parts, strict=True):
            yield cid, ch.pack(own, np.minimum(n[np.searchsorted(v, own)], np.iinfo(np.int64).max))

    replies = ch.over_buckets(sent.where("bucket >= 0"), reply, ch.REPLIES)
    return Counts(n_tokens + n_ends, n_words + (n_ends > 0), n_ends, *best), sent, replies


def class_starts(entries: int) -> np.ndarray:
    """Where each class of entries starts, and the end. Entries come by frequency; with widths that grow as the root of the
    place, frequent words lie in narrow classes, which for words that follow Zipf's law costs least."""
    starts = [0]
    while starts[-1] < entries:
        starts.append(min(entries, starts[-1] + math.ceil(WIDTH * math.sqrt(starts[-1] + 1))))
    return np.array(starts)


class Network:
    """Parameters and passes. Entries: 0 is the end, 1 all words outside the vocabulary, from 2 on the words."""

    def __init__(self, entries: int, hidden: int = HIDDEN, seed: int = 5, weights: np.ndarray | None = None) -> None:
        self.entries, self.hidden = entries, hidden
        self.starts = class_starts(entries)
        self.classes = len(self.starts) - 1
        self.class_of = np.repeat(np.arange(self.classes), np.diff(self.starts))
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.1: rng.normal(0, s, shape).astype(np.float32)
        h = hidden
        self.p = {
            "x": draw(entries, 3 * h), "u": draw(h, 3 * h, s=1 / np.sqrt(h)), "b": np.zeros(3 * h, np.float32),
            "c": draw(h, self.classes), "cb": np.zeros(self.classes, np.float32),
            "w": draw(entries, h), "wb": np.zeros(entries, np.float32),
        }
        if weights is not None:
            at = 0
            for k, v in self.p.items():
                self.p[k] = weights[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unigram(self, counts: np.ndarray) -> None:
        """Starts the output biases at the entries' smoothed shares."""
        full = np.asarray(counts, float) + 0.5
        of_class = np.add.reduceat(full, self.starts[:-1])
        self.p["cb"] = np.log(of_class / full.sum()).astype(np.float32)
        self.p["wb"] = np.log(full / of_class[self.class_of]).astype(np.float32)

    def place(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place in it) of each entry."""
        k = self.class_of[target]
        return k, target - self.starts[k]

    def _gates(self, given: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(new state, update and reset gates, candidate, what the reset gate multiplies) of what inputs give and states ``h``."""
        n = self.hidden
        u = h @ self.p["u"]
        zr = u[:, : 2 * n] + given[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = zr[:, n:] * u[:, 2 * n :]
        c += given[:, 2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= zr[:, :n]
        new += c
        return new, zr, c, u[:, 2 * n :]

    def step(self, given: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States after ``h`` and what inputs give."""
        return self._gates(given, h)[0]

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities after states ``h``."""
        k, place = self.place(target)
        out = np.empty(len(target))
        for lo in range(0, len(target), BLOCK):
            part = slice(lo, lo + BLOCK)
            out[part] = _log_shares(h[part] @ self.p["c"], self.p["cb"], k[part], False)[0]
        order, cuts = _by_class(k)
        x, place = h[order], place[order]
        second = np.empty(len(target))
        for cls, a, b in cuts:
            own = slice(self.starts[cls], self.starts[cls + 1])
            for lo in range(a, b, BLOCK):
                part = slice(lo, min(lo + BLOCK, b))
                second[part] = _log_shares(x[part] @ self.p["w"][own].T, self.p["wb"][own], place[part], False)[0]
        out[order] += second
        return out

    def train(self, docs: list[np.ndarray], rate: float = 0.02, window: int = WINDOW, rows: int = TRAIN_ROWS, seed: int = 3) -> int:
        """Truncated backpropagation over documents (entries, ended by 0); the number of tokens seen.

        Steps grow to their full length at first, and are shorter where less than half of ``rows`` documents are left, so
        that the end of a very long one moves the network by what it weighs.
        """
        order = np.random.default_rng(seed).permutation(len(docs))
        docs = [docs[i] for i in order]
        docs = sorted(docs, key=lambda d: -len(d))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        starts = list(range(0, len(docs), rows))
        seen = t = 0
        for at in np.random.default_rng(seed).permutation(len(starts)).tolist():
            group = docs[starts[at] : starts[at] + rows]
            h = np.zeros((len(group), self.hidden), np.float32)
            last = np.zeros(len(group), np.int64)
            for lo in range(0, len(group[0]), window):
                live = sum(len(d) > lo for d in group)  # longest first
                h, last = h[:live], last[:live]
                steps = min(window, len(group[0]) - lo)
                target = np.zeros((steps, live), np.int64)
                real = np.zeros((steps, live), bool)
                for k, d in enumerate(group[:live]):
                    part = d[lo : lo + steps]
                    target[: len(part), k], real[: len(part), k] = part, True
                grads, h, last, n = self._window(target, real, h, last)
                seen, t = seen + n, t + 1
                # plain floats: with numpy's own, all of this would be done in double precision
                norm = math.sqrt(sum(float(np.vdot(g, g)) for g, _ in grads.values()))
                clip, size = min(1.0, 1.0 / (norm + 1e-8)), rate * min(1.0, t / 10, 2 * n / (rows * window)) / (1 - 0.9**t)
                for k, (g, at_) in grads.items():  # of the input table, only the rows that were used move
                    mean, square = m[k][at_], s[k][at_]  # views, but of the input table
                    mean *= 0.9
                    mean += (0.1 * clip) * g
                    np.multiply(g, g, out=g)
                    g *= 0.01 * clip * clip
                    square *= 0.99
                    square += g
                    if k == "x":
                        m[k][at_], s[k][at_] = mean, square
                    np.sqrt(square, out=g)
                    g *= 1 / math.sqrt(1 - 0.99**t)
                    g += 1e-6
                    np.divide(mean, g, out=g)
                    g *= size
                    self.p[k][at_] -= g
        return seen

    def _window(self, target: np.ndarray, real: np.ndarray, h: np.ndarray, last: np.ndarray):
        steps, rows, n = *target.shape, self.hidden
        inputs = np.concatenate([last[None], target[:-1]])
        used, at_used = np.unique(inputs, return_inverse=True)
        given = (self.p["x"][used] + self.p["b"])[at_used.ravel()].reshape(steps, rows, 3 * n)
        kind = given.dtype
        states = np.empty((steps + 1, rows, n), kind)
        states[0] = h
        z, r, c, uc = (np.empty((steps, rows, n), kind) for _ in range(4))
        for i in range(steps):
            states[i + 1], zr, c[i], uc[i] = self._gates(given[i], states[i])
            z[i], r[i] = zr[:, :n], zr[:, n:]
        hs = states[1:].reshape(-1, n)
        k, place = self.place(target.ravel())
        w = real.ravel()
        total = max(1, int(w.sum()))
        g = {"w": np.zeros_like(self.p["w"]), "wb": np.zeros_like(self.p["wb"])}
        y = _log_shares(hs @ self.p["c"], self.p["cb"], k)[1]
        y[np.arange(len(k)), k] -= 1
        y *= (w / total).astype(kind)[:, None]
        g["c"], g["cb"] = hs.T @ y, y.sum(axis=0)
        dh = y @ self.p["c"].T
        own = np.flatnonzero(w)
        order, cuts = _by_class(k[own])
        own = own[order]
        x, place, back = hs[own], place[own], np.empty((len(own), n), kind)
        # states lie between -1 and 1, so no logit is beyond this; classes are many and narrow, so calls count
        safe = float((np.abs(self.p["w"]).sum(axis=1) + np.abs(self.p["wb"])).max()) < 40
        at_own, ones, share = np.arange(len(own)), np.ones(max(len(own), int(np.diff(self.starts).max())), kind), 1 / total
        for cls, a, b in cuts:
            at = slice(self.starts[cls], self.starts[cls + 1])
            table_, given_ = self.p["w"][at], x[a:b]
            q = given_ @ table_.T
            q += self.p["wb"][at]
            if not safe:
                q -= q.max(axis=1, keepdims=True)
            np.exp(q, out=q)
            q *= (share / (q @ ones[: len(table_)]))[:, None]
            q[at_own[: b - a], place[a:b]] -= share
            np.matmul(q.T, given_, out=g["w"][at])
            np.matmul(ones[: b - a], q, out=g["wb"][at])
            np.matmul(q, table_, out=back[a:b])
        dh[own] += back
        dh = dh.reshape(steps, rows, n)
        # of candidate c and gates z, r, all at once: the factors that don't depend on what comes back
        rest = 1 - z
        f_z = states[:-1] - c
        f_z *= z
        f_z *= rest
        f_c = c * c
        np.subtract(1, f_c, out=f_c)
        f_c *= rest
        f_r = np.subtract(1, r, out=rest)
        f_r *= r
        f_r *= uc
        gates, dc = np.empty((steps, rows, 3 * n), kind), np.empty((steps, rows, n), kind)  # of z, r and what r multiplies; of c
        ut = np.ascontiguousarray(self.p["u"].T)
        back = np.zeros_like(h)
        for i in range(steps - 1, -1, -1):
            d, now = dh[i], gates[i]
            d += back
            np.multiply(d, f_c[i], out=dc[i])
            np.multiply(d, f_z[i], out=now[:, :n])
            np.multiply(dc[i], f_r[i], out=now[:, n : 2 * n])
            np.multiply(dc[i], r[i], out=now[:, 2 * n :])
            back = now @ ut
            d *= z[i]
            back += d
        gates = gates.reshape(-1, 3 * n)
        g["u"] = states[:-1].reshape(-1, n).T @ gates
        gates[:, 2 * n :] = dc.reshape(-1, n)
        g["b"] = gates.sum(axis=0)
        order = np.argsort(at_used.ravel().astype(np.uint16 if len(used) <= 1 << 16 else np.int64), kind="stable")
        count = np.bincount(at_used.ravel())
        g["x"] = np.add.reduceat(gates[order], np.cumsum(count) - count, axis=0)
        return {k: (v, used if k == "x" else slice(None)) for k, v in g.items()}, states[-1], target[-1], int(w.sum())

    def score(self, docs: list[np.ndarray], rows: int = SCORE_ROWS, window: int = WINDOW) -> np.ndarray:
        """Natural log-likelihood of each document (entries, ended by 0); states go on across windows."""
        out = np.zeros(len(docs))
        gates_of = self.p["x"] + self.p["b"]
        order = np.array(sorted(range(len(docs)), key=lambda i: -len(docs[i])), np.int64)
        for at in range(0, len(docs), rows):
            own = order[at : at + rows]
            group = [docs[i] for i in own]
            length = np.array([len(d) for d in group])
            first = np.concatenate([[0], np.cumsum(length)])[:-1]
            flat = np.concatenate(group)
            h = np.zeros((len(group), self.hidden), np.float32)
            last = np.zeros(len(group), np.int64)
            for lo in range(0, int(length[0]), window):
                hs, targets, who = [], [], []
                for i in range(lo, min(lo + window, int(length[0]))):
                    live = int(np.searchsorted(-length, -i, side="left"))
                    h, last = h[:live], last[:live]
                    h = self.step(gates_of[last], h)
                    last = flat[first[:live] + i]
                    hs.append(h)
                    targets.append(last)
                    who.append(np.arange(live))
                logs = self.log_probabilities(np.concatenate(hs), np.concatenate(targets))
                out[own] += np.bincount(np.concatenate(who), weights=logs, minlength=len(group))
        return out


def _log_shares(x: np.ndarray, bias: np.ndarray, place: np.ndarray, shares: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(logarithm of each row's softmax at its place, the softmax if ``shares``); overwrites ``x``, to which the bias is added first."""
    x += bias
    if x.max(initial=0) > 40 or x.min(initial=0) < -40:  # else exponentials and their sums are well within range as they are
        x -= x.max(axis=1, keepdims=True)
    at = x[np.arange(len(x)), place]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if shares:
        x *= (1 / total)[:, None]
    return at - np.log(total), x


def _by_class(k: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by class, and (class, from, to) of each in it."""
    order = np.argsort(k.astype(np.uint16), kind="stable")
    count = np.bincount(k)
    ends = np.cumsum(count)
    return order, [(c, int(ends[c] - count[c]), int(ends[c])) for c in np.flatnonzero(count).tolist()]


class Vocabulary:
    def __init__(self, words: np.ndarray) -> None:
        self.order = np.argsort(words)
        self.sorted = words[self.order]

    def entries(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.ones(len(h), np.int64)
        at = np.searchsorted(self.sorted, h)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == h, self.order[at] + 2, 1)


PREPARED = "cid long, data binary"


@dataclass
class Texts:
    """The documents of a chunk as entries: ``flat`` with every document's end, ``n`` tokens each; ids, folds and what doesn't depend on the network."""

    ids: pa.Array
    held_out: np.ndarray
    train: np.ndarray
    n: np.ndarray
    known: np.ndarray
    base: np.ndarray
    inner: np.ndarray
    flat: np.ndarray

    def docs(self, rows: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum(self.n)
        return [self.flat[ends[r] - self.n[r] : ends[r]].astype(np.int64) for r in rows.tolist()]


def prepare(chunks: DataFrame, replies: DataFrame, counts: Counts) -> DataFrame:
    """The corpus as entries of the vocabulary, a row a chunk: texts are cut into words once, and every round and the scoring read this."""
    share = chunks.sparkSession.sparkContext.broadcast(counts)

    def run(chunk: Chunk, blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        counts = share.value
        inside = int(counts.counts.sum())
        n_rest, v_rest = counts.tokens - counts.ends - inside, counts.distinct - (counts.ends > 0) - len(counts.words)
        base_of = lambda c: np.log10((c + 0.5) / (counts.tokens + 0.5 * (counts.distinct + 1)))
        h, owner, n = tokens(chunk)
        pairs = [ch.unpack(b) for b in blobs]
        words = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, _U)
        count_of = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        order = np.argsort(words)
        at = order[np.searchsorted(words[order], h)] if len(h) else np.zeros(0, np.int64)
        c = count_of[at]
        entries = Vocabulary(counts.words).entries(words)[at] if len(words) else np.zeros(0, np.int64)
        base = np.bincount(owner, weights=base_of(count_of)[at], minlength=chunk.rows) + base_of(counts.ends)
        known = np.bincount(owner, weights=c > 0, minlength=chunk.rows).astype(np.int64) + (counts.ends > 0)
        outside = np.log10((c + 0.5) / (n_rest + 0.5 * (v_rest + 1))) * (entries == 1)
        inner = np.bincount(owner, weights=outside, minlength=chunk.rows)
        flat = np.zeros(len(h) + chunk.rows, np.uint16 if len(counts.words) + 2 <= 1 << 16 else np.uint32)
        flat[np.arange(len(h)) + owner] = entries
        ids = chunk.batch.column("doc_id")
        held_out, train = held_out_rows(ids)
        yield chunk.cid, ch.squeeze(ch.pack(ids.is_null().to_numpy(zero_copy_only=False), chunk.ids, held_out, train, n + 1, known, base, inner, flat))

    return table(ch.over_chunks(ch.with_replies(chunks, replies), run, PREPARED), "entries")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts]]:
    for batch in batches:
        for cid, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            null, ids, *rest = ch.unpack(ch.expand(blob.as_py()))
            yield cid, Texts(pa.array(ids, mask=null), *rest)


def train(prepared: DataFrame, counts: Counts, hidden: int = HIDDEN, rounds: int = ROUNDS) -> Network:
    entries = len(counts.words) + 2
    rest = max(0, counts.tokens - counts.ends - int(counts.counts.sum()))
    net = Network(entries, hidden)
    net.unigram(np.concatenate([[counts.ends, rest], counts.counts]))
    spark = prepared.sparkSession
    trained = "salt int, tokens long, blob binary"
    for k in range(rounds):
        share = spark.sparkContext.broadcast(net.flat())

        def improve(batches: Iterator[pa.RecordBatch], k: int = k, share=share) -> Iterator[pa.RecordBatch]:
            own, seen, docs, size, salt = Network(entries, hidden, weights=share.value), 0, [], 0, 0
            for cid, texts in _texts(batches):
                # each training document is in one round
                turn = tb.mix(np.arange(len(texts.n), dtype=_U) ^ tb.mix(np.array([cid], _U))) % _U(rounds)
                part = texts.docs(np.flatnonzero(texts.train & (turn == k)))
                docs, size, salt = docs + part, size + sum(map(len, part)), zlib.crc32(f"{cid}:{salt}".encode())
                if size > 400_000:  # a bound on what is held; training goes on with the next ones
                    seen, docs, size = seen + own.train(docs), [], 0
            if docs:
                seen += own.train(docs)
            if seen:
                yield ch._rows(trained, [(salt & 0x7FFFFFFF, seen, own.flat().tobytes())])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen, salt = None, 0, 0
            for batch in batches:
                for s, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    w = np.frombuffer(blob.as_buffer(), np.float32).astype(np.float64) * n
                    total, seen, salt = w if total is None else total + w, seen + n, zlib.crc32(f"{s}:{salt}".encode())
            if seen:
                yield ch._rows(trained, [(salt & 0x7FFFFFFF, seen, (total / seen).astype(np.float32).tobytes())])

        parts = table(prepared.mapInArrow(improve, trained), "network")
        while (left := parts.count()) > FAN_IN:  # a level of the tree: so many networks to a task, whatever their number
            fewer = table(parts.repartition(-(-left // FAN_IN), "salt").mapInArrow(average, trained), "network")
            remove(parts)
            parts = fewer
        total, seen = 0.0, 0
        for r in parts.toLocalIterator():  # as many as one task averages, at most
            total, seen = total + np.frombuffer(r["blob"], np.float32).astype(np.float64) * r["tokens"], seen + r["tokens"]
        remove(parts)
        share.destroy()
        if seen:
            net = Network(entries, hidden, weights=total / seen)
    return net


def score(docs: DataFrame, vocabulary: int = VOCABULARY, hidden: int = HIDDEN) -> DataFrame:
    """The columns of ``RESULT`` for every row of ``docs`` (doc_id, text): counts, unigram base and the model's log10 probability."""
    chunks, size = ch.store(docs, "lm")
    counts, sent, replies = count(chunks, ch.bucket_count(size), vocabulary)
    prepared = prepare(chunks, replies, counts)
    remove(chunks, sent)
    net = train(prepared, counts, hidden)
    share = docs.sparkSession.sparkContext.broadcast((net, counts.tokens))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = share.value
        held: list[Texts] = []

        def flush() -> pa.RecordBatch:
            scores = net.score([d for t in held for d in t.docs(np.arange(len(t.n)))]) / np.log(10) + np.concatenate([t.inner for t in held])
            ids = pa.concat_arrays([t.ids for t in held])
            held_out, n, known, base = (np.concatenate([getattr(t, name) for t in held]) for name in ("held_out", "n", "known", "base"))
            row = [ids, pa.array(held_out), pa.array(n), pa.array(known), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(scores)]
            held.clear()
            return pa.RecordBatch.from_arrays(row, names=[f.split()[0] for f in RESULT.split(", ")])

        for _, texts in _texts(batches):
            held.append(texts)
            if sum(len(t.flat) for t in held) > 3_000_000 or sum(len(t.n) for t in held) >= 4 * SCORE_ROWS:
                yield flush()
        if held:
            yield flush()

    return prepared.mapInArrow(judge, RESULT)
