"""Every query of the engine by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cases, described, design, queries as q

_NAMES = (
    "bm25_topk", "token_frequencies", "bm25_saturated_confidence", "bm25_gate", "tfidf_topk", "dense_cosine_topk", "dense_field_weighted", "dense_confidence",
    "hashed_dense_topk", "quality_prior_rerank", "nearest_example_vote", "rrf_hybrid", "borda_committee", 
    "gate_auroc", "precision_coverage", "latency_percentiles", "poor_match_suppression", "margin_entropy", "agreement", "reliability_bins", 
    "platt_calibration", "isotonic_calibration", "quantized_vectors",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: getattr(q, n) for n in _NAMES} | described.QUERIES | cases.QUERIES | design.QUERIES
#: back-references, look-behinds and fitted models have no SQL form in the comparison engine
ORACLE: dict[str, str] = {n: getattr(q, n.upper()) for n in _NAMES if hasattr(q, n.upper())} | described.ORACLE | cases.ORACLE | design.ORACLE
