"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (hashed into a fixed number of rows) and of the word
itself; a document is the mean of its words; a linear softmax reads that mean. Misspellings never seen share n-grams
with words that were. As every step before the softmax is linear, a trained model scores a document from one number a
word, so scoring is a pass of vectorised lookups over whole texts.

The model is fitted on the driver from a bounded sample of labelled rows (``max_rows`` of each label, the first by a
hash of doc_id); its bias is corrected from the sample's class shares to those of all training labels.

Defined cases: a text without words (null, empty, white space) gets the score of the bias alone; rows are scored one by
one, so repeated rows and ties get equal scores; null labels and null ids aren't trained on, contradictory labels of an
id count as toxic; without both classes in training the score is the share of toxic labels (0 without labels); an empty
table gives an empty result. Only the text is ever an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textblocks as tb
from .shared import arrow_rows

ROWS = 1 << 17
GRAMS = (3, 4, 5)
DIM = 4
#: Most labelled rows of either label that the model is fitted on.
MAX_ROWS = 3000
EPOCHS = 12
#: Share of a bag's rows left out at each step of training.
DROPPED = 0.4
FOLDS, HELD_OUT = 5, 0

FEATURES = "doc_id long, rows binary, weights binary"


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, its place among distinct words, and each distinct word's embedding rows: owner, row, weight)."""
    raw, off = tb.arrow_block(texts)
    buf = tb.LOWER[raw]
    start, end, owner = tb.words(buf, off, tb.NOT_SPACE)
    none = np.zeros(0, np.int64)
    if not len(start):
        return owner, none, none, none, np.zeros(0, np.float32)
    h = tb.byte_prefix(buf).slices(start, end)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    # a buffer of the distinct words, each between two marks
    size = e - s + 2
    at = np.concatenate([[0], np.cumsum(size)])
    marked = np.empty(at[-1], np.uint8)
    take = np.arange(at[-1]) - np.repeat(at[:-1], size) - 1 + np.repeat(s, size)
    marked[:] = buf[np.clip(take, 0, len(buf) - 1)]
    marked[at[:-1]], marked[at[1:] - 1] = ord("<"), ord(">")
    prefix, word = tb.byte_prefix(marked), np.repeat(np.arange(len(s)), size)
    owners, rows = [np.arange(len(s))], [prefix.slices(at[:-1], at[1:])]
    for n in GRAMS:
        i = tb.windows(marked, word, n)
        i = i[size[word[i]] > n]  # else it's the word itself
        owners.append(word[i])
        rows.append(prefix.slices(i, i + n))
    owners, rows = np.concatenate(owners), (np.concatenate(rows) >> np.uint64(64 - 17)).astype(np.int64)
    return owner, place, owners, rows, (1 / np.bincount(owners, minlength=len(s)))[owners].astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, rows, weights): the embedding rows that average to each document, as packed int32 and float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], []]
            for k in range(batch.num_rows):
                owner, place, word, row, weight = word_rows(batch.column(1).slice(k, 1))
                count = np.bincount(place) if len(place) else np.zeros(0)
                total = np.bincount(row, weights=weight * count[word], minlength=1) / max(1, len(owner)) if len(row) else np.zeros(1)
                used = np.flatnonzero(total)
                out[0].append(used.astype(np.int32).tobytes())
                out[1].append(total[used].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.binary()) for c in out]], names=["doc_id", "rows", "weights"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FEATURES)


@dataclass
class Model:
    #: what each embedding row adds to the log-odds, and the bias
    rows: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, place, word, row, weight = word_rows(texts)
        logit = np.full(len(texts), self.bias)
        if len(owner):
            by_word = np.bincount(word, weights=self.rows[row] * weight, minlength=int(word.max()) + 1)
            total = np.bincount(owner, weights=by_word[place], minlength=len(texts))
            logit += total / np.maximum(1, np.bincount(owner, minlength=len(texts)))
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, epochs: int = EPOCHS, dim: int = DIM, seed: int = 7) -> Model:
    """Embeddings and softmax from bags of (rows, weights), by sparse Adagrad on the cross entropy of both classes."""
    labels = np.asarray(labels, np.int64)
    odds = lambda p: float(np.log(p / (1 - p)))
    share = min(max(share, 1e-6), 1 - 1e-6)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(ROWS, np.float32), odds(share))
    rng = np.random.default_rng(seed)
    gain = 64.0  # means over hundreds of words are small
    emb = rng.normal(0, 0.05, (ROWS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(ROWS, 1e-6, np.float32), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
    sizes = np.array([len(r) for r, _ in bags])
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            pick = pick[sizes[pick] > 0]
            if not len(pick):
                continue
            rows = np.concatenate([bags[i][0] for i in pick])
            weights = np.concatenate([bags[i][1] for i in pick]) * gain
            weights *= (rng.random(len(weights)) >= DROPPED).astype(np.float32) / (1 - DROPPED)  # no n-gram may carry a word alone
            starts = np.concatenate([[0], np.cumsum(sizes[pick])[:-1]])
            x = np.add.reduceat(emb[rows] * weights[:, None], starts, axis=0)
            z = x @ soft + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            d = p
            d[np.arange(len(pick)), labels[pick]] -= 1
            d /= len(pick)
            dx = np.repeat(d @ soft.T, sizes[pick], axis=0) * weights[:, None]
            o = np.argsort(rows, kind="stable")
            used, first = np.unique(rows[o], return_index=True)
            grad = np.add.reduceat(dx[o], first, axis=0)
            for param, state, g in ((soft, g_soft, x.T @ d), (bias, g_bias, d.sum(axis=0))):
                state += g * g
                param -= 0.3 * rate * g / np.sqrt(state)
            g_emb[used] += (grad * grad).mean(axis=1)
            emb[used] -= rate * grad / np.sqrt(g_emb[used])[:, None]
    direction = soft[:, 1] - soft[:, 0]
    seen = labels.mean()
    return Model((emb @ direction * gain).astype(np.float32), float(bias[1] - bias[0]) + odds(share) - odds(seen))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, held_out: int | None = HELD_OUT) -> Model:
    """A model of ``labels.toxic`` on texts of ``docs``; ``held_out`` is the fold of doc_ids left out, None for none."""
    arrow_rows(docs.sparkSession, 1000)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    if held_out is not None:
        known = known.where(fold() != held_out)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    chosen = {r["doc_id"]: r["toxic"] for p in parts for r in p.collect()}  # at most 2 * max_rows
    spark = docs.sparkSession
    ids = spark.createDataFrame(list(chosen.items()) or [], "doc_id long, toxic int").select("doc_id")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    rows = features(sample).groupBy("doc_id").agg(F.min_by("rows", "rows").alias("rows"), F.min_by("weights", "rows").alias("weights"))
    bags = sorted(((r["doc_id"], np.frombuffer(r["rows"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in rows.toLocalIterator()), key=lambda b: b[0])
    return fit([b[1:] for b in bags], np.array([chosen[b[0]] for b in bags], np.int64), share)


def fold():
    """crc32 of doc_id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic, from the text alone."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    arrow_rows(docs.sparkSession, 1000)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = share.value.scores(batch.column("text").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, by a model trained on all labels."""
    return score(docs, train(docs, labels, held_out=None), "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
