"""Ranking and abstention metrics as DataFrame aggregates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def gold_ranks(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, rank) for each (query_id, doc_id) of ``gold``: the place of the gold document, null where it isn't ranked."""
    return gold.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))


def rank_metrics(ranks: DataFrame, k: int) -> DataFrame:
    """One row: precision at 1, recall at k, mean reciprocal rank, nDCG at k for one gold document a query, and their number."""
    r = F.when(F.col("rank") <= k, F.col("rank"))
    return ranks.agg(
        F.avg(F.coalesce((r == 1).cast("double"), F.lit(0.0))).alias("precision_at_1"),
        F.avg(r.isNotNull().cast("double")).alias("recall_at_k"),
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(1.0 / F.log2(r + 1.0), F.lit(0.0))).alias("ndcg_at_k"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def running(rows: DataFrame, by: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``rows``, which have distinct values of ``by``, with ``upto_<column>``: the column's sum over all rows up to and with each.

    Rows are dealt out by cut points of ``by``, summed up where they are, and shifted by the sums of the cuts before them:
    what one task sees is a share of the rows, and one row a cut.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.where(F.col(by).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)  # read for the cuts, their sums and the rows
    cuts = sorted(set(known.select(F.col(by).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)
    dealt = known.withColumn("_cut", -place if descending else place)
    before = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)  # a row a cut
    sums = dealt.groupBy("_cut").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    shift = sums.select("_cut", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    here = Window.partitionBy("_cut").orderBy(F.desc(by) if descending else F.col(by)).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(F.broadcast(shift), "_cut")
    return met.select(*rows.columns, *[(F.sum(c).over(here) + F.col(f"_b_{c}")).alias(f"upto_{c}") for c in columns])


def _by_score(observed: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """Positives and negatives of each distinct score, and their totals."""
    tied = observed.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q"))
    return tied, tied.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))


def auroc(observed: DataFrame, score: str = "score") -> DataFrame:
    """One row: the area under the ROC curve of ``label`` (0 or 1), ties counted half; null without both classes."""
    tied, total = _by_score(observed, score)
    won = running(tied, "s", ["q"]).withColumn("won", F.col("p") * (F.col("upto_q") - F.col("q") / 2))
    pairs = F.first("tp") * F.first("tq")
    return won.crossJoin(F.broadcast(total)).agg(F.when(pairs > 0, F.sum("won") / F.nullif(pairs, F.lit(0.0))).alias("auroc"))


def auprc(observed: DataFrame, score: str = "score") -> DataFrame:
    """One row: average precision, ties taken together."""
    tied, total = _by_score(observed, score)
    at = running(tied, "s", ["p", "q"], descending=True).crossJoin(F.broadcast(total))
    return at.agg((F.sum(F.col("p") * F.col("upto_p") / (F.col("upto_p") + F.col("upto_q"))) / F.nullif(F.first("tp"), F.lit(0.0))).alias("auprc"))


def precision_at_coverage(observed: DataFrame, coverages: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """(coverage, precision): mean of ``correct`` over the most confident share of queries, ties by id; half-even rounding, one at least."""
    tied = observed.groupBy("confidence").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("correct").cast("long")).alias("p"))
    upto = running(tied, "confidence", ["c", "p"], descending=True)
    n = observed.agg(F.count(F.lit(1)).alias("n"))
    shares = observed.sparkSession.createDataFrame([(c,) for c in coverages], "coverage double")
    cuts = shares.crossJoin(n).withColumn("cut", F.greatest(F.lit(1.0), F.rint(F.col("coverage") * F.col("n"))).cast("long"))
    met = upto.join(F.broadcast(cuts), F.col("upto_c") - F.col("c") < F.col("cut"))
    whole = met.where(F.col("upto_c") <= F.col("cut")).groupBy("coverage").agg(F.sum("p").alias("won"))
    # of the group that a cut goes through, those with the smallest ids count
    split = met.where(F.col("upto_c") > F.col("cut")).select("coverage", F.col("confidence").alias("at"), (F.col("cut") - (F.col("upto_c") - F.col("c"))).alias("room"))
    own = Window.partitionBy("coverage").orderBy("query_id")
    some = observed.join(F.broadcast(split), F.col("confidence") == F.col("at")).withColumn("r", F.row_number().over(own)).where(F.col("r") <= F.col("room"))
    part = some.groupBy("coverage").agg(F.sum(F.col("correct").cast("long")).alias("won"))
    won = whole.unionByName(part).groupBy("coverage").agg(F.sum("won").alias("won"))
    return cuts.where("n > 0").join(won, "coverage", "left").select("coverage", (F.coalesce("won", F.lit(0)) / F.col("cut")).alias("precision"))


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """One row: interpolated median, and the order statistic at max(1, floor(0.95 n)); no row without values."""
    v = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    upto = running(v.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v", ["c"])
    n = v.agg(F.count(F.lit(1)).alias("n"))
    at = lambda place: F.min(F.when(F.col("upto_c") >= place, F.col("v")))
    middle = at(F.ceil(F.col("n") / 2)) / 2 + at(F.floor(F.col("n") / 2) + 1) / 2
    place = F.greatest(F.lit(1.0), F.floor(F.lit(0.95) * F.col("n")).cast("double"))
    return upto.crossJoin(F.broadcast(n)).groupBy("n").agg(middle.alias("p50"), at(place).alias("p95")).select("p50", "p95", "n")


def suppression(poor: DataFrame, top: DataFrame) -> DataFrame:
    """One row: share of (query_id, bad_doc_id) whose best match is another document or none."""
    met = poor.join(top.select("query_id", F.col("doc_id").alias("top_id")), "query_id", "left")
    return met.agg(F.avg((F.col("top_id").isNull() | (F.col("top_id") != F.col("bad_doc_id"))).cast("double")).alias("suppression"), F.count(F.lit(1)).alias("n"))


def reliability(observed: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_probability, accuracy) over equal-width bins of ``probability``."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return observed.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg(F.col("label").cast("double")).alias("accuracy"))


def calibration_error(observed: DataFrame, bins: int = 10) -> DataFrame:
    """One row: the expected calibration error."""
    r = reliability(observed, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Cohen's kappa of two labellings."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = known.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col(a) == F.col(b)).cast("double")).alias("same"))
    rows = known.groupBy(F.col(a).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    cols = known.groupBy(F.col(b).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select(((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def krippendorff(ratings: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha of nominal (item, rater, value); items with fewer than two values say nothing, repeated rows count."""
    known = ratings.where(F.col("value").isNotNull())
    cells = known.groupBy("item", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    items = cells.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") ** 2).alias("cc")).where("m > 1")
    seen = items.agg(F.sum("m").alias("n"), F.sum((F.col("m") ** 2 - F.col("cc")) / (F.col("m") - 1)).alias("apart"))
    shares = cells.join(items.select("item"), "item").groupBy("value").agg(F.sum("c").alias("v")).agg(F.sum(F.col("v") ** 2).alias("vv"))
    expected = (F.col("n") ** 2 - F.col("vv")) / (F.col("n") - 1)
    return seen.crossJoin(shares).select((1 - F.col("apart") / F.nullif(expected, F.lit(0.0))).alias("alpha"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of mid-ranks, ranked over distinct values."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = known
    for c in ("a", "b"):
        counts = running(known.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, ["n"])
        ranks = counts.select(c, (F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))
        ranked = ranked.join(ranks, c)
    return ranked.agg(F.corr("ra", "rb").alias("rho"))


def abstention(observed: DataFrame, wrong_cost: float = 1.0, abstain_cost: float = 0.2) -> DataFrame:
    """One row: precision, recall and F1 of showing, and the mean utility of (shown, correct) decisions."""
    shown, right = F.col("shown").cast("double"), F.col("correct").cast("double")
    sums = observed.agg(F.sum(shown * right).alias("tp"), F.sum(shown).alias("s"), F.sum(right).alias("c"), F.count(F.lit(1)).cast("double").alias("n"))
    p, r = F.col("tp") / F.nullif("s", F.lit(0.0)), F.col("tp") / F.nullif("c", F.lit(0.0))
    return sums.select(
        p.alias("precision"), r.alias("recall"), (2 * F.col("tp") / F.nullif(F.col("s") + F.col("c"), F.lit(0.0))).alias("f1"),
        ((F.col("tp") - wrong_cost * (F.col("s") - F.col("tp")) - abstain_cost * (F.col("n") - F.col("s"))) / F.col("n")).alias("utility"))


#: Columns of a printed leaderboard.
BOARD = ("precision_at_1", "recall_at_k", "mrr", "ndcg_at_k", "gate_auroc", "poor_match_suppression", "latency_p50_ms", "latency_p95_ms")


@F.udf(T.StringType())
def _printed(value: float | None) -> str | None:
    """Three places as C prints them: of the number's binary value, so 0.1125, a little more than that, is 0.113; Spark's rounding starts from its shortest decimals."""
    return None if value is None else f"{value:.3f}"


def _cell(df: DataFrame, name: str) -> Column:
    """A number with three places, a whole number as it is, n/a where there is none."""
    if name not in df.columns:
        return F.lit("n/a")
    if dict(df.dtypes)[name] in ("int", "bigint", "smallint", "tinyint"):
        return F.coalesce(F.col(name).cast("string"), F.lit("n/a"))
    value = F.col(name).cast("double")
    return F.when(value.isNull(), "n/a").when(F.isnan(value), "nan").otherwise(_printed(value))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """(method, metric, value): a metrics row per method unpivoted, as printed."""
    names = [c for c in metrics.columns if c != "method"]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), _cell(metrics, c).alias("value")) for c in names])
    return metrics.select("method", F.inline(pairs))


def markdown(metrics: DataFrame, columns: tuple[str, ...] = BOARD) -> str:
    """The leaderboard as a Markdown table, a line a method in order of their names."""
    rows = metrics.select("method", F.concat(F.lit("| "), F.concat_ws(" | ", "method", *[_cell(metrics, c) for c in columns]), F.lit(" |")).alias("line")).orderBy("method").collect()
    head = "| method | " + " | ".join(columns) + " |"
    return "\n".join([head, "|" + "---|" * (len(columns) + 1), *(r["line"] for r in rows)])
