"""The abstention gate: show the best match only where confidence reaches a threshold, and calibration of the gauge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# fixed value
THRESHOLD = 3.6


@dataclass(frozen=True)
class Gate:
    """``threshold`` applies to confidence, or with coefficients ``a`` and ``b`` to the probability 1 / (1 + exp(-(a c + b)))."""

    threshold: float = THRESHOLD
    a: float | None = None
    b: float | None = None

    def gauge(self, confidence: Column) -> Column:
        return confidence if self.a is None else 1 / (1 + F.exp(-(self.a * confidence + self.b)))

    def decide(self, queries: DataFrame, top: DataFrame, confidence: DataFrame) -> DataFrame:
        """A row for every query: (query_id, doc_id, score, confidence, shown, reason); doc_id is kept even if not shown."""
        kind = "confidence" if self.a is None else "prob"
        met = queries.select("query_id").join(top.select("query_id", "doc_id", "score"), "query_id", "left").join(confidence, "query_id", "left")
        c = F.coalesce("confidence", F.lit(0.0))
        found, gauge = F.col("doc_id").isNotNull(), self.gauge(c)
        shown = found & (gauge >= self.threshold)
        reason = F.when(~found, "no candidates").when(shown, "shown").otherwise(
            F.format_string(f"{kind} %.3f < threshold {self.threshold:.3f}", F.bround(gauge, 3)))
        return met.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), c.alias("confidence"), shown.alias("shown"), reason.alias("reason"))


def platt(observed: DataFrame, threshold: float) -> Gate:
    """A calibrated gate from (confidence, correct): logistic regression with a unit ridge on the slope; uncalibrated with one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = observed.select(F.col("correct").cast("double").alias("label"), array_to_vector(F.array(F.col("confidence").cast("double"))).alias("features"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first()
    if not n or low == high:
        return Gate(threshold)
    model = LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    return Gate(threshold, float(model.coefficients[0]), float(model.intercept))


def isotonic(observed: DataFrame) -> DataFrame:
    """(confidence, probability): the isotonic fit of correctness at the observed confidences."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    rows = observed.select("confidence", F.col("correct").cast("double").alias("label"), array_to_vector(F.array(F.col("confidence").cast("double"))).alias("features"))
    return IsotonicRegression().fit(rows).transform(rows).select("confidence", F.col("prediction").alias("probability"))
