"""The engine's queries over the driver's tables: benchmark items are queries, documents and embeddings are corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions import text as tx
from rankloom.operators import dense, gate as g, lexical, metrics, rank

K = 10
FIELDS = [(0, 16, 0.5), (16, 32, 1.0), (32, 48, 1.0), (48, 64, 0.3)]
QUALITY_WEIGHT = 0.05
HASH_DIM = 64


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _saturated(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best of each query, and the moments of all its scores."""
    return lexical.pool(_docs(spark, sf), _asked(spark, sf), k, squash=True)


def _n(spark: SparkSession, sf: str) -> int:
    return _read(spark, sf, "documents").count()


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return rows, rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")


def hashed_vectors(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector): token counts by md5 bucket; one shuffle of partial sums."""
    bucket = (F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 4), 16, 10).cast("int") % HASH_DIM).alias("b")
    found = rows.select(key, F.explode_outer(tx.tokens(F.col("text"))).alias("term")).select(key, bucket)
    sums = [F.count(F.when(F.col("b") == i, 1)).cast("double") for i in range(HASH_DIM)]
    return found.groupBy(key).agg(F.array(*sums).alias("vector"))


def _hashed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return hashed_vectors(_docs(spark, sf), "doc_id"), hashed_vectors(_asked(spark, sf), "query_id")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id): documents that contain an item word for word.

    An item's inner tokens stand whole in any text that contains it; the rarest of them finds the documents to look at.
    Items of fewer than three tokens, a small part of a stated query set, are looked for in every document.
    """
    docs, items = _docs(spark, sf), _asked(spark, sf).where("text is not null").select("query_id", F.col("text").alias("item"))
    inner = items.withColumn("inner", F.array_distinct(F.slice(tx.tokens(F.col("item")), 2, F.greatest(F.size(tx.tokens(F.col("item"))) - 2, F.lit(0)))))
    common = lexical.frequencies(docs)
    each = inner.select("query_id", "item", F.explode("inner").alias("term")).join(common, "term", "left")
    anchors = each.groupBy("query_id", "item").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("term"))
    found = docs.select("doc_id", "text", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).join(F.broadcast(anchors) if lexical.few(anchors) else anchors, "term")
    short = inner.where(F.size("inner") == 0).select("query_id", "item")
    rest = docs.crossJoin(F.broadcast(short)) if lexical.few(short) else docs.crossJoin(short)
    met = found.select("query_id", "doc_id", "text", "item").unionByName(rest.select("query_id", "doc_id", "text", "item"))
    return met.where(F.col("text").contains(F.col("item"))).select("query_id", "doc_id").distinct()


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, confidence, correct): is the best match a gold document?"""
    top, own = _saturated(spark, sf, 1)
    top = top.select("query_id", "doc_id").join(_gold(spark, sf).withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    sure = rank.confidence_of(own, _n(spark, sf))
    return _asked(spark, sf).select("query_id").join(sure, "query_id", "left").join(top, "query_id", "left").select(
        "query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("hit", F.lit(0)).alias("correct")).persist()  # a row a query


def _placed(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.bround("score", 4).alias("score"), *extra)


# --- SQL shared by several queries -------------------------------------------------------------------------------
_TOKENS = "regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')"
_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
_BM25 = f"""asked AS (SELECT item_id AS query_id, text FROM benchmark),
dt AS (SELECT doc_id, {_TOKENS.format(t='text')} AS terms FROM documents),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM dt),
tf AS (SELECT doc_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM dt) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format(t='text')}) AS term FROM asked) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw_score
       FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY query_id, doc_id),
sat AS (SELECT query_id, doc_id, CASE WHEN raw_score > 0 THEN raw_score / (raw_score + 8) ELSE 0 END AS score FROM bm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sat),
own AS (SELECT query_id, count(*) AS c, avg(score) AS m, var_pop(score) AS v, max(score) AS top FROM sat GROUP BY query_id),
spread AS (SELECT query_id, top, m * c / n AS mean, c * (v + (m - m * c / n) ** 2) + (n - c) * (m * c / n) ** 2 AS ss, n, c FROM own, st),
conf AS (SELECT query_id, CASE WHEN sqrt(ss / n) <= 1e-9 THEN 0 ELSE (CASE WHEN c < n THEN greatest(top, 0) ELSE top END - mean) / sqrt(ss / n) END AS confidence FROM spread),
gold AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)),
observed AS (SELECT q.item_id AS query_id, coalesce(confidence, 0) AS confidence, (g.doc_id IS NOT NULL)::INT AS correct
             FROM benchmark q LEFT JOIN conf ON conf.query_id = q.item_id LEFT JOIN ranked r ON r.query_id = q.item_id AND r.rank = 1
             LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id)
"""
_HASHED = f"""
hd AS (SELECT doc_id AS id, list_transform(range(64), lambda i: len(list_filter({_TOKENS.format(t='text')}, lambda t: ('0x' || substr(md5(t), 1, 4))::INT % 64 = i))::DOUBLE) AS v FROM documents),
hq AS (SELECT item_id AS id, list_transform(range(64), lambda i: len(list_filter({_TOKENS.format(t='text')}, lambda t: ('0x' || substr(md5(t), 1, 4))::INT % 64 = i))::DOUBLE) AS v FROM benchmark),
hs AS (SELECT hq.id AS query_id, hd.id AS doc_id,
              list_inner_product(hq.v, hd.v) / ((CASE WHEN list_inner_product(hq.v, hq.v) = 0 THEN 1 ELSE sqrt(list_inner_product(hq.v, hq.v)) END)
              * (CASE WHEN list_inner_product(hd.v, hd.v) = 0 THEN 1 ELSE sqrt(list_inner_product(hd.v, hd.v)) END)) AS score FROM hq, hd)
"""
_VECTORS = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0)
"""


def _cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / ((CASE WHEN list_inner_product({a}, {a}) = 0 THEN 1 ELSE sqrt(list_inner_product({a}, {a})) END) * (CASE WHEN list_inner_product({b}, {b}) = 0 THEN 1 ELSE sqrt(list_inner_product({b}, {b})) END))"


def token_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.inverse_frequencies(_docs(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


TOKEN_FREQUENCIES = f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf"


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(lexical.pool(_docs(spark, sf), _asked(spark, sf), K, places=rank.RAW_PLACES)[0])


BM25_TOPK = f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 6) DESC, doc_id)::INT AS rank FROM bm)
SELECT query_id, doc_id, rank, round(raw_score, 4) AS score FROM r WHERE rank <= 10"""


def bm25_saturated_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return rank.confidence_of(_saturated(spark, sf, 1)[1], _n(spark, sf)).select("query_id", F.round("confidence", 4).alias("confidence"))


BM25_SATURATED_CONFIDENCE = f"WITH {_BM25} SELECT query_id, round(confidence, 4) AS confidence FROM conf"


def bm25_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on whole items, most of which are unsure; on the longest word of each, most of which are sure; and on words that nothing has."""
    items = _asked(spark, sf)
    words = F.array_sort(F.transform(tx.tokens(F.col("text")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    rare = items.select((F.col("query_id") + 100_000).alias("query_id"), F.get(words, F.lit(0))["t"].alias("text"))
    none = items.select((F.col("query_id") + 200_000).alias("query_id"), F.concat(F.lit("zq"), F.col("query_id").cast("string"), F.lit("qz")).alias("text"))
    asked = items.unionByName(rare).unionByName(none)
    top, own = lexical.pool(_docs(spark, sf), asked, 1, squash=True)
    made = g.Gate().decide(asked, top, rank.confidence_of(own, _n(spark, sf)))
    return made.select("query_id", "doc_id", F.bround("score", 4).alias("score"), F.bround("confidence", 3).alias("confidence"), "shown", "reason")


_GATED = f"""{_ITEMS} UNION ALL SELECT item_id + 200000, 'zq' || item_id || 'qz' FROM benchmark UNION ALL
SELECT item_id + 100000, list_sort(list_transform({_TOKENS.format(t='text')}, lambda t: {{'n': -length(t), 't': t}}))[1].t FROM benchmark"""
BM25_GATE = f"""WITH {_BM25.replace(_ITEMS, _GATED)} SELECT b.query_id, r.doc_id, round_even(coalesce(r.score, 0), 4) AS score, round_even(coalesce(confidence, 0), 3) AS confidence,
  r.doc_id IS NOT NULL AND coalesce(confidence, 0) >= 3.6 AS shown,
  CASE WHEN r.doc_id IS NULL THEN 'no candidates' WHEN coalesce(confidence, 0) >= 3.6 THEN 'shown' ELSE printf('confidence %.3f < threshold 3.600', coalesce(confidence, 0)::DOUBLE) END AS reason
FROM asked b LEFT JOIN ranked r ON r.query_id = b.query_id AND r.rank = 1 LEFT JOIN conf ON conf.query_id = b.query_id"""


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(lexical.pool(_docs(spark, sf), _asked(spark, sf), K, "tfidf", places=rank.RAW_PLACES)[0])


TFIDF_TOPK = f"""WITH {_BM25}, s AS (SELECT query_id, doc_id, sum(qtf * (1 + ln(tf)) * ln(n / df::DOUBLE)) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 10"""


def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(dense.topk(*_vectors(spark, sf), K, skip_self=True))


def _dense_sql(score: str) -> str:
    return f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {score} AS score FROM q, e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 10"""


DENSE_COSINE_TOPK = _dense_sql(_cos("q.v", "e.v"))


def dense_field_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(dense.topk(*_vectors(spark, sf), K, fields=FIELDS, skip_self=True))


DENSE_FIELD_WEIGHTED = _dense_sql("(" + " + ".join(f"{w}::DOUBLE * {_cos(f'q.v[{a + 1}:{b}]', f'e.v[{a + 1}:{b}]')}" for a, b, w in FIELDS) + ") / 2.8::DOUBLE")


def dense_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return dense.sums(*_vectors(spark, sf)).select("query_id", F.round("confidence", 4).alias("confidence"))


DENSE_CONFIDENCE = f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, {_cos('q.v', 'e.v')} AS score FROM q, e)
SELECT query_id, round(CASE WHEN stddev_pop(score) <= 1e-9 THEN 0 ELSE (max(score) - avg(score)) / stddev_pop(score) END, 4) AS confidence FROM s GROUP BY query_id"""


def hashed_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(dense.topk(*_hashed(spark, sf), K))


HASHED_DENSE_TOPK = f"""WITH {_HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM hs)
SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 10"""


def quality_prior_rerank(spark: SparkSession, sf: str) -> DataFrame:
    prior = _read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = _docs(spark, sf).join(prior, "doc_id", "left").select("doc_id", "text", (QUALITY_WEIGHT * F.coalesce("quality", F.lit(0))).alias("prior"))
    return _placed(lexical.pool(docs, _asked(spark, sf), K, squash=True)[0])


QUALITY_PRIOR_RERANK = f"""WITH {_BM25}, p AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
s AS (SELECT query_id, doc_id, score + 0.05::DOUBLE * coalesce(quality, 0) AS score FROM sat LEFT JOIN p USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 10"""


def nearest_example_vote(spark: SparkSession, sf: str) -> DataFrame:
    return dense.grouped(*_vectors(spark, sf), "label").select("query_id", F.col("owner").alias("label"), F.round("score", 6).alias("score"))


NEAREST_EXAMPLE_VOTE = f"""WITH {_VECTORS} SELECT q.vec_id AS query_id, e.label::BIGINT AS label, round(greatest(max(CASE WHEN q.vec_id = e.vec_id THEN -1 ELSE {_cos('q.v', 'e.v')} END), 0), 6) AS score
FROM q, e GROUP BY q.vec_id, e.label"""


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    members = [_saturated(spark, sf, 50)[0].select("query_id", "doc_id", "score"), dense.topk(*_hashed(spark, sf), 50).select("query_id", "doc_id", "score")]
    return rank.fused(members, K).select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), F.round("score", 4).alias("score"), F.col("rank").cast("int").alias("rank"))


RRF_HYBRID = f"""WITH {_BM25}, {_HASHED}, hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hs),
l AS (SELECT query_id, doc_id, score, rank, rank AS met FROM ranked WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, score, rank, 1000 + rank FROM hr WHERE rank <= 50),
f AS (SELECT query_id, doc_id, sum(1 / (60 + rank)::DOUBLE) AS rrf, greatest(max(score), 0) AS score, min(met) AS met FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, met)::INT AS rank FROM f)
SELECT query_id, doc_id, round(rrf, 6) AS rrf, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""


def borda_committee(spark: SparkSession, sf: str) -> DataFrame:
    members = [_saturated(spark, sf, 50)[0].select("query_id", "doc_id", "score"), dense.topk(*_hashed(spark, sf), 50).select("query_id", "doc_id", "score")]
    return rank.borda(members, 50).select("query_id", "doc_id", F.col("points").cast("long").alias("points"))


BORDA_COMMITTEE = f"""WITH {_BM25}, {_HASHED}, hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hs),
l AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM hr WHERE rank <= 50)
SELECT query_id, doc_id, sum(50 - rank)::BIGINT AS points FROM l GROUP BY ALL"""


def gate_auroc(spark: SparkSession, sf: str) -> DataFrame:
    seen = _observed(spark, sf).select(F.round("confidence", 9).alias("score"), F.col("correct").alias("label"))
    return metrics.auroc(seen).crossJoin(metrics.auprc(seen)).select(F.round("auroc", 4).alias("auroc"), F.round("auprc", 4).alias("auprc"))


GATE_AUROC = f"""WITH {_BM25}, o AS (SELECT round(confidence, 9) AS s, correct FROM observed),
pairs AS (SELECT sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) / nullif(count(*), 0) AS auroc FROM o a, o b WHERE a.correct = 1 AND b.correct = 0),
t AS (SELECT s, sum(correct) AS p, count(*) AS c FROM o GROUP BY s), cum AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(c) OVER (ORDER BY s DESC) AS cc FROM t)
SELECT round((SELECT auroc FROM pairs), 4) AS auroc, round(sum(p * cp::DOUBLE / cc) / nullif(sum(p), 0), 4) AS auprc FROM cum"""


def precision_coverage(spark: SparkSession, sf: str) -> DataFrame:
    seen = _observed(spark, sf).withColumn("confidence", F.round("confidence", 9))
    return metrics.precision_at_coverage(seen).select("coverage", F.round("precision", 4).alias("precision"))


PRECISION_COVERAGE = f"""WITH {_BM25}, o AS (SELECT correct, row_number() OVER (ORDER BY round(confidence, 9) DESC, query_id) AS place, count(*) OVER () AS n FROM observed)
SELECT coverage, round(avg(correct::DOUBLE), 4) AS precision FROM o, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) AS c(coverage) WHERE place <= greatest(1, round_even(coverage * n, 0)) GROUP BY coverage"""


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.percentiles(_read(spark, sf, "events"), "value").select(F.round("p50", 6).alias("p50"), "p95", "n")


LATENCY_PERCENTILES = """WITH o AS (SELECT value::DOUBLE AS v, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT round((SELECT quantile_cont(v, 0.5) FROM o), 6) AS p50, v AS p95, n FROM o WHERE r = greatest(1, floor(0.95::DOUBLE * n))"""


def poor_match_suppression(spark: SparkSession, sf: str) -> DataFrame:
    poor = _gold(spark, sf).groupBy("query_id").agg(F.min("doc_id").alias("bad_doc_id"))
    return metrics.suppression(poor, _saturated(spark, sf, 1)[0]).select(F.round("suppression", 6).alias("suppression"), "n")


POOR_MATCH_SUPPRESSION = f"""WITH {_BM25}, p AS (SELECT query_id, min(doc_id) AS bad FROM gold GROUP BY query_id)
SELECT round(avg((r.doc_id IS NULL OR r.doc_id <> bad)::INT::DOUBLE), 6) AS suppression, count(*) AS n FROM p LEFT JOIN ranked r ON r.query_id = p.query_id AND r.rank = 1"""


def margin_entropy(spark: SparkSession, sf: str) -> DataFrame:
    top = _saturated(spark, sf, K)[0]
    return rank.margin(top).join(rank.entropy(top), "query_id").select("query_id", F.round("margin", 4).alias("margin"), F.round("entropy", 4).alias("entropy"))


MARGIN_ENTROPY = f"""WITH {_BM25}, t AS (SELECT * FROM ranked WHERE rank <= 10), z AS (SELECT query_id, sum(exp(score)) AS z FROM t GROUP BY query_id)
SELECT query_id, round(max(CASE WHEN rank = 1 THEN score END) - min(CASE WHEN rank <= 2 THEN score END), 4) AS margin, round(-sum(exp(score) / z * ln(exp(score) / z)), 4) AS entropy FROM t JOIN z USING (query_id) GROUP BY query_id"""


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "labels")
    sizes = _read(spark, sf, "documents").join(rows, "doc_id").select(F.col("n_chars").alias("a"), F.col("quality").alias("b"))
    return metrics.kappa(rows, "quality", "toxic").crossJoin(metrics.spearman(sizes, "a", "b")).select(F.round("kappa", 6).alias("kappa"), F.round("rho", 6).alias("rho"))


AGREEMENT = """WITH l AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*)::DOUBLE AS n, sum((a = b)::INT) AS same FROM l),
c AS (SELECT sum(x * y) AS xy FROM (SELECT a AS v, count(*)::DOUBLE AS x FROM l GROUP BY a) JOIN (SELECT b AS v, count(*)::DOUBLE AS y FROM l GROUP BY b) USING (v)),
s AS (SELECT n_chars AS a, quality AS b FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM s)
SELECT round((same / n - xy / (n * n)) / nullif(1 - xy / (n * n), 0), 6) AS kappa, (SELECT round(corr(ra, rb), 6) FROM r) AS rho FROM t, c"""


def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    seen = _observed(spark, sf).select((F.round("confidence", 6) / (F.round("confidence", 6) + 4)).alias("probability"), F.col("correct").alias("label"))
    return metrics.reliability(seen).select("bin", "n", F.round("mean_probability", 5).alias("mean_probability"), F.round("accuracy", 5).alias("accuracy"))


RELIABILITY_BINS = f"""WITH {_BM25}, o AS (SELECT round(confidence, 6) / (round(confidence, 6) + 4) AS p, correct FROM observed)
SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 5) AS mean_probability, round(avg(correct::DOUBLE), 5) AS accuracy FROM o GROUP BY 1"""


def _calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, confidence, correct) with confidences rounded, so that calibration sees equal numbers in any engine."""
    return _observed(spark, sf).withColumn("confidence", F.round("confidence", 6))


def platt_calibration(spark: SparkSession, sf: str) -> DataFrame:
    seen = _calibrated(spark, sf)
    return seen.select("query_id", F.round(g.platt(seen, 0.5).gauge(F.col("confidence")), 4).alias("probability"))


#: Newton's steps on the sum of losses and half the squared slope.
PLATT_CALIBRATION = f"""WITH RECURSIVE {_BM25}, o AS MATERIALIZED (SELECT query_id, round(confidence, 6)::DOUBLE AS x, correct::DOUBLE AS y FROM observed), xs AS MATERIALIZED (SELECT list(x) AS xs, list(y) AS ys FROM o),
newton(i, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, a + list_sum(list_transform(range(1, len(xs) + 1), lambda k: (1 / (1 + exp(-(a * xs[k] + b))) - ys[k]) * xs[k])) AS ga, list_sum(list_transform(range(1, len(xs) + 1), lambda k: 1 / (1 + exp(-(a * xs[k] + b))) - ys[k])) AS gb,
      1 + list_sum(list_transform(xs, lambda x: x * x * exp(-(a * x + b)) / (1 + exp(-(a * x + b))) ** 2)) AS haa, list_sum(list_transform(xs, lambda x: x * exp(-(a * x + b)) / (1 + exp(-(a * x + b))) ** 2)) AS hab,
      list_sum(list_transform(xs, lambda x: exp(-(a * x + b)) / (1 + exp(-(a * x + b))) ** 2)) AS hbb FROM newton, xs WHERE i < 30))
SELECT query_id, round(1 / (1 + exp(-(a * x + b))), 4) AS probability FROM o, newton WHERE i = 30"""


def isotonic_calibration(spark: SparkSession, sf: str) -> DataFrame:
    seen = g.isotonic(_calibrated(spark, sf)).distinct()
    return seen.select("confidence", F.round("probability", 6).alias("probability"))


#: The largest over starts up to here of the smallest over ends from here of the mean between them.
ISOTONIC_CALIBRATION = f"""WITH {_BM25}, t AS (SELECT round(confidence, 6) AS x, sum(correct) AS s, count(*) AS n FROM observed GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY x) AS i, * FROM t),
m AS (SELECT a.i AS i, b.i AS j, sum(k.s) / sum(k.n)::DOUBLE AS mean FROM c a JOIN c b ON a.i <= b.i JOIN c k ON k.i BETWEEN a.i AND b.i GROUP BY ALL),
l AS (SELECT c.i AS at, m.i, min(mean) AS low FROM c JOIN m ON m.i <= c.i AND m.j >= c.i GROUP BY ALL)
SELECT c.x AS confidence, round(max(low), 6) AS probability FROM c JOIN l ON l.at = c.i GROUP BY c.x"""


def quantized_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _vectors(spark, sf)
    v = F.transform("vector", lambda x: x.cast("double"))
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    codes = F.transform(v, lambda x: F.rint(x / F.when(top == 0, 1.0).otherwise(top) * 127).cast("int"))
    return rows.select(F.col("doc_id").alias("vec_id"), F.aggregate(codes, F.lit(0), lambda s, x: s + x).cast("long").alias("code_sum"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive_bits"))


QUANTIZED_VECTORS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM e)
SELECT vec_id, list_sum(list_transform(v, lambda x: round_even(x / CASE WHEN top = 0 THEN 1 ELSE top END * 127, 0)::INT))::BIGINT AS code_sum, len(list_filter(v, lambda x: x > 0))::BIGINT AS positive_bits FROM m"""
