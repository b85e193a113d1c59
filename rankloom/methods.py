"""The matching methods by key, over one described corpus: B0, B1, M1, M2 and M3; ranking, search and decisions by any of them.

A corpus has ``doc_id``, ``prior`` and the text fields of ``readers.descriptions``; ``char`` is optional, and B1 takes a
ready ``text`` instead of the fields. A method gives
for a query relation (query_id, text) its ``k`` best documents and its confidence, over all documents of the corpus:
those with which nothing matches count, and rank, as zeros. Nothing is computed before a result is asked for, but for
the query vectors, a stated set.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from rankloom.operators import dense, encode, gate as g, lexical, rank
from rankloom.sources import readers

# fixed values
FIELD_WEIGHTS = {"visual_concepts": 0.5, "task_intents": 1.0, "example_tasks": 1.0, "reasoning": 0.3}
KEYS = ("B0", "B1", "M1", "M2", "M3")


@dataclass(frozen=True)
class Settings:
    quality_weight: float = 0.05
    threshold: float = g.THRESHOLD
    k: int = 10
    rrf_constant: int = 60
    field_weights: Mapping[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))

    @classmethod
    def from_env(cls, environ: Mapping[str, str] = os.environ) -> Settings:
        """RANKLOOM_QUALITY_WEIGHT and RANKLOOM_ABSTAIN_THRESHOLD over the defaults."""
        return cls(quality_weight=float(environ.get("RANKLOOM_QUALITY_WEIGHT", cls.quality_weight)), threshold=float(environ.get("RANKLOOM_ABSTAIN_THRESHOLD", cls.threshold)))


def view(name: str, include_examples: bool = True):
    """The text of a view: ``document``, or one field."""
    if name == "document":
        return readers.document(include_examples)
    if name not in FIELD_WEIGHTS:
        raise KeyError(name)
    return F.col(name) if name == "reasoning" else readers.field_text(F.col(name))


@dataclass
class Result:
    """``top``: (query_id, doc_id, score, rank) of the k best; ``confidence``: (query_id, confidence)."""

    top: DataFrame
    confidence: DataFrame


class Lexical:
    """B1: saturated BM25 of the concatenated texts."""

    def __init__(self, corpus: DataFrame, include_examples: bool) -> None:
        self.docs = corpus.select("doc_id", (F.col("text") if "text" in corpus.columns else view("document", include_examples)).alias("text"))

    def pool(self, queries: DataFrame, k: int) -> Result:
        top, own = lexical.pool(self.docs, queries, k, squash=True)
        return Result(rank.padded(top, self.docs, queries, k), rank.confidence_of(own, self.docs.agg(F.count(F.lit(1)).alias("n"))))


class Dense:
    """B0: cosine with the concatenated text. M1: the weighted mean of cosines with each field, and the prior's share."""

    def __init__(self, corpus: DataFrame, encoder: encode.Encoder, weights: Mapping[str, float] | None, quality_weight: float, include_examples: bool, cache: str | None = None) -> None:
        self.encoder, self.cache = encoder, cache
        if weights is not None and not include_examples:
            weights = {f: w for f, w in weights.items() if f != "example_tasks"}
        self.names = list(weights) if weights is not None else ["document"]
        self.weights = list(weights.values()) if weights is not None else [1.0]
        self.quality = quality_weight
        rows = corpus.select("doc_id", "prior", *[view(f, include_examples).alias(f"t_{f}") for f in self.names])
        for f in self.names:
            rows = encode.vectors(rows, encoder, f"t_{f}", f, False, cache).withColumnRenamed("vector", f"v_{f}")
        self.rows = rows.select("doc_id", "prior", F.concat(*[f"v_{f}" for f in self.names]).alias("vector"))

    def pool(self, queries: DataFrame, k: int) -> Result:
        own = encode.vectors(queries.select("query_id", "text"), self.encoder, "text", "query", True, self.cache)
        dim = own.select(F.size("vector")).first()
        width = dim[0] if dim else 0
        asked = own.select("query_id", F.concat(*["vector"] * len(self.names)).alias("vector"))
        slices = [(i * width, (i + 1) * width, w) for i, w in enumerate(self.weights)]
        prior = self.quality * F.col("prior") if self.quality else None
        return Result(*dense.pool(self.rows, asked, k, slices, prior))


class NearestExample:
    """M2: the best cosine with a document's own examples, 0 at least and without examples, and the prior's share."""

    def __init__(self, corpus: DataFrame, encoder: encode.Encoder, quality_weight: float, held_out: DataFrame | None = None, how: str = "max", cache: str | None = None) -> None:
        self.encoder, self.cache, self.quality, self.how = encoder, cache, quality_weight, how
        examples = corpus.select("doc_id", F.explode("example_tasks").alias("text"))
        if held_out is not None:
            left_out = held_out.select("text").distinct()
            examples = examples.join(F.broadcast(left_out) if lexical.few(left_out) else left_out, "text", "left_anti")
        own = encode.vectors(examples, encoder, "text", "examples", False, cache).groupBy("doc_id").agg(F.collect_list("vector").alias("vectors"))
        self.rows = corpus.select("doc_id", "prior").join(own, "doc_id", "left")

    def pool(self, queries: DataFrame, k: int) -> Result:
        asked = encode.vectors(queries.select("query_id", "text"), self.encoder, "text", "query", True, self.cache).select("query_id", "vector")
        return Result(*dense.pool_lists(self.rows, asked, k, self.how, self.quality * F.col("prior")))


class Hybrid:
    """M3: reciprocal rank fusion of members; its confidence is the largest of theirs."""

    def __init__(self, members: list, constant: int = 60) -> None:
        self.members, self.constant = members, constant

    def pool(self, queries: DataFrame, k: int) -> Result:
        size = max(5 * k, 50)
        found = [m.pool(queries, size) for m in self.members]
        top = rank.fused([f.top for f in found], k, size, self.constant).select("query_id", "doc_id", "score", "rank")
        return Result(top, rank.best_signal([f.confidence for f in found]))


def build(key: str, corpus: DataFrame, include_examples: bool = True, held_out: DataFrame | None = None, settings: Settings | None = None, encoder: encode.Encoder | None = None, cache: str | None = None):
    """The method of a key; ``held_out`` texts are no examples of M2, and ``include_examples=False`` keeps all examples out of the others."""
    s, e = settings or Settings(), encoder or encode.hashing()
    if key == "B0":
        return Dense(corpus, e, None, 0.0, include_examples, cache)
    if key == "B1":
        return Lexical(corpus, include_examples)
    if key == "M1":
        return Dense(corpus, e, s.field_weights, s.quality_weight, include_examples, cache)
    if key == "M2":
        return NearestExample(corpus, e, s.quality_weight, held_out, cache=cache)
    if key == "M3":
        return Hybrid([build(m, corpus, include_examples, held_out, s, e, cache) for m in ("B1", "M1")], s.rrf_constant)
    raise KeyError(f"unknown method {key!r}; there are {', '.join(KEYS)}")


def decide(method, queries: DataFrame, gate: g.Gate | None = None) -> DataFrame:
    """A decision for every query."""
    found = method.pool(queries, 1)
    return (gate or g.Gate()).decide(queries, found.top.where("rank = 1"), found.confidence)


def search(corpus: DataFrame, queries: DataFrame, key: str = "M3", k: int = 12, gate: g.Gate | None = None, **options) -> DataFrame:
    """(query_id, query, method, decision_id, shown, confidence, reason, hits): for each query its ``k`` best with score, char and whether shown.

    ``k`` is 12 where it is no number, the method M3 where the key is unknown, as a search box wants it. A text that is
    empty or only white space gives no hits and the reason "empty query".
    """
    key = key if key in KEYS else "M3"
    k = int(k) if str(k).lstrip("-").isdigit() else 12
    asked = queries.select("query_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    real = asked.where("text <> ''")
    found = build(key, corpus, **options).pool(real, k)
    decision = (gate or g.Gate()).decide(real, found.top.where("rank = 1"), found.confidence)
    glyph = corpus.select("doc_id", (F.col("char") if "char" in corpus.columns else F.lit("")).alias("char"))
    hit = F.struct("rank", "doc_id", F.bround("score", 4).alias("score"), F.coalesce("char", F.lit("")).alias("char"), ((F.col("rank") == 1) & F.col("shown")).alias("shown"))
    hits = found.top.join(glyph, "doc_id", "left").join(decision.select("query_id", "shown"), "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    met = asked.join(decision, "query_id", "left").join(hits, "query_id", "left")
    return met.select(
        "query_id", F.col("text").alias("query"), F.lit(key).alias("method"), F.when(F.col("shown"), F.col("doc_id")).alias("decision_id"), F.coalesce("shown", F.lit(False)).alias("shown"),
        F.bround(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), F.coalesce("reason", F.lit("empty query")).alias("reason"), F.coalesce("hits", F.array()).alias("hits"))
