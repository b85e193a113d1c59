"""Queries of the further operators over the embeddings: votes, density, thresholds, selection, feedback, several vectors, short codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.operators import dense, metrics, outliers, rank, selection

from .queries import _VECTORS, FIELDS, _cos, _vectors

_PAIRS = f"WITH {_VECTORS}, p AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, e.label, {_cos('q.v', 'e.v')} AS score FROM q, e WHERE q.vec_id <> e.vec_id)"


def _vote(how: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows, asked = _vectors(spark, sf)
        return dense.grouped(rows, asked, "label", how).select("query_id", F.col("owner").alias("label"), F.round("score", 6).alias("score"))

    return query


VOTE_MEAN = f"{_PAIRS} SELECT query_id, label, round(avg(score), 6) AS score FROM p GROUP BY ALL"
VOTE_SOFTMAX = f"{_PAIRS} SELECT query_id, label, round(ln(avg(exp(score))), 6) AS score FROM p GROUP BY ALL"


def knn_density(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.density(*_vectors(spark, sf), 8, skip_self=True).select("query_id", F.round("density", 6).alias("density"))


KNN_DENSITY = f"{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p) SELECT query_id, round(avg(score), 6) AS density FROM r WHERE rank <= 8 GROUP BY query_id"


def mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    """Over the first two components, for which SQL has the inverse of the covariance in closed form."""
    rows, asked = (dense.truncated(d, 2) for d in _vectors(spark, sf))
    return outliers.mahalanobis(rows, asked, 0.0).select("query_id", F.round("distance", 5).alias("distance"))


MAHALANOBIS = f"""WITH {_VECTORS}, m AS (SELECT avg(v[1]) AS mx, avg(v[2]) AS my, var_pop(v[1]) AS sx, var_pop(v[2]) AS sy, covar_pop(v[1], v[2]) AS sxy FROM e)
SELECT vec_id AS query_id, round(sqrt((sy * (v[1] - mx) ** 2 - 2 * sxy * (v[1] - mx) * (v[2] - my) + sx * (v[2] - my) ** 2) / (sx * sy - sxy ** 2)), 5) AS distance FROM q, m"""


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, confidence, correct): is a vector's nearest one of its label, and how near?"""
    rows, asked = _vectors(spark, sf)
    top = dense.topk(rows, asked, 1, skip_self=True).select("query_id", "doc_id", F.round("score", 6).alias("confidence"))
    own = rows.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"))
    return top.join(own, "query_id").join(rows.select("doc_id", "label"), "doc_id").select("query_id", "confidence", (F.col("own") == F.col("label")).cast("int").alias("correct"))


_SEEN = f"""{_PAIRS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p) WHERE rank = 1),
o AS (SELECT query_id, round(score, 6) AS confidence, (t.label = q.label)::INT AS correct FROM t JOIN q ON q.vec_id = query_id)"""


def conformal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.conformal(_observed(spark, sf), 0.2)


CONFORMAL_THRESHOLD = f"""{_SEEN}, r AS (SELECT confidence, row_number() OVER (ORDER BY confidence) AS place, count(*) OVER () AS n FROM o WHERE correct = 1)
SELECT max(confidence) FILTER (place = floor(0.2::DOUBLE * (n + 1))) AS threshold, max(n) AS n FROM r"""


def temperature(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.temperature(_observed(spark, sf)).select(F.round("temperature", 6).alias("temperature"), F.round("loss", 6).alias("loss"))


TEMPERATURE = f"""{_SEEN}, g AS (SELECT 10 ** (-1 + 2 * i / 60.0::DOUBLE) AS t FROM range(61) r(i)),
l AS (SELECT t, avg(ln(1 + exp(-CASE WHEN correct = 1 THEN confidence ELSE -confidence END / t))) AS loss FROM o, g GROUP BY t)
SELECT round(t, 6) AS temperature, round(loss, 6) AS loss FROM l ORDER BY round(l.loss, 12), t LIMIT 1"""


def abstention_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Showing what is nearer than 0.9 of the mean confidence."""
    seen = _observed(spark, sf)
    cut = seen.agg(F.avg("confidence").alias("cut"))
    m = metrics.abstention(seen.crossJoin(F.broadcast(cut)).withColumn("shown", (F.col("confidence") >= 0.9 * F.col("cut")).cast("int")))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


ABSTENTION_SCORES = f"""{_SEEN}, x AS (SELECT (confidence >= 0.9::DOUBLE * (SELECT avg(confidence) FROM o))::INT AS shown, correct FROM o), s AS (SELECT sum(shown * correct)::DOUBLE AS tp, sum(shown)::DOUBLE AS s, sum(correct)::DOUBLE AS c, count(*)::DOUBLE AS n FROM x)
SELECT round(tp / nullif(s, 0), 6) AS precision, round(tp / nullif(c, 0), 6) AS recall, round(2 * tp / nullif(s + c, 0), 6) AS f1, round((tp - (s - tp) - 0.2::DOUBLE * (n - s)) / n, 6) AS utility FROM s"""


def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The gold document of a vector is the one after the next of its label by id; most rank it low or not at all."""
    rows, asked = _vectors(spark, sf)
    own = rows.select(F.col("doc_id").alias("query_id"), "label").where("query_id % 20 = 0")
    gold = own.join(rows.select("doc_id", "label"), "label").where("doc_id > query_id").groupBy("query_id").agg(F.element_at(F.array_sort(F.collect_list("doc_id")), 1).alias("doc_id"))
    m = metrics.rank_metrics(metrics.gold_ranks(gold, dense.topk(rows, asked, 30, skip_self=True)), 30)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns if c != "n_queries"], "n_queries")


RANK_METRICS = f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p),
g AS (SELECT q.vec_id AS query_id, min(e.vec_id) AS doc_id FROM q JOIN e ON e.label = q.label AND e.vec_id > q.vec_id GROUP BY q.vec_id),
x AS (SELECT g.query_id, CASE WHEN rank <= 30 THEN rank END AS rank FROM g JOIN r USING (query_id, doc_id))
SELECT round(avg(coalesce((rank = 1)::INT, 0)::DOUBLE), 6) AS precision_at_1, round(avg((rank IS NOT NULL)::INT::DOUBLE), 6) AS recall_at_k, round(avg(coalesce(1 / rank::DOUBLE, 0)), 6) AS mrr,
  round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg_at_k, count(*) AS n_queries FROM x"""


def krippendorff_alpha(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/labels.parquet")
    long = rows.select(F.col("doc_id").alias("item"), F.explode(F.array(F.col("quality").cast("int"), (1 - F.col("toxic")).cast("int"))).alias("value"))
    return metrics.krippendorff(long).select(F.round("alpha", 6).alias("alpha"))


KRIPPENDORFF_ALPHA = """WITH l AS (SELECT doc_id, unnest([quality::INT, (1 - toxic)::INT]) AS v FROM labels), k AS (SELECT * FROM l WHERE v IS NOT NULL), m AS (SELECT doc_id, count(*) AS m FROM k GROUP BY doc_id HAVING count(*) > 1),
c AS (SELECT k.doc_id, v, m FROM k JOIN m USING (doc_id)), i AS (SELECT row_number() OVER () AS i, * FROM c),
d AS (SELECT sum(CASE WHEN a.v <> b.v THEN 1.0::DOUBLE / (a.m - 1) ELSE 0 END) AS apart FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.i <> b.i),
s AS (SELECT v, count(*)::DOUBLE AS n FROM c GROUP BY v), t AS (SELECT sum(n) AS n, sum(n * n) AS nn FROM s)
SELECT round(1 - apart / nullif((n * n - nn) / (n - 1), 0), 6) AS alpha FROM d, t"""


def rocchio_feedback(spark: SparkSession, sf: str) -> DataFrame:
    rows, asked = _vectors(spark, sf)
    moved = dense.rocchio(rows, asked, 5, skip_self=True)
    return dense.topk(rows, moved, 5, skip_self=True).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 5).alias("score"))


ROCCHIO_FEEDBACK = f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p),
mv AS (SELECT query_id, i, avg(e.v[i]) AS x FROM r JOIN e ON e.vec_id = doc_id, unnest(range(1, 65)) t(i) WHERE rank <= 5 GROUP BY ALL),
nq AS (SELECT query_id, list(q.v[i] + 0.75::DOUBLE * x ORDER BY i) AS v FROM mv JOIN q ON q.vec_id = query_id GROUP BY query_id),
s AS (SELECT query_id, vec_id AS doc_id, {_cos('nq.v', 'e.v')} AS score FROM nq, e WHERE query_id <> vec_id),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 5) AS score FROM z WHERE rank <= 5"""


def max_field(spark: SparkSession, sf: str) -> DataFrame:
    return dense.topk(*_vectors(spark, sf), 10, fields=FIELDS, skip_self=True, best_field=True).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


_SLICES = [_cos(f"q.v[{a + 1}:{b}]", f"e.v[{a + 1}:{b}]") for a, b, _ in FIELDS]
MAX_FIELD = f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, greatest({', '.join(f'{w}::DOUBLE * {c}' for (_, _, w), c in zip(FIELDS, _SLICES, strict=True))}) AS score FROM q, e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""


def late_interaction(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in slices of 16 stand for token vectors."""
    rows, asked = _vectors(spark, sf)
    parts = lambda d, key: d.select(F.col(key), F.explode(F.transform(F.array(*map(F.lit, range(4))), lambda i: F.slice("vector", i * 16 + 1, 16))).alias("vector"))
    found = dense.max_sim(parts(rows, "doc_id").withColumnRenamed("doc_id", "owner"), parts(asked, "query_id"), 5).withColumnRenamed("owner", "doc_id")
    return found.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 5).alias("score"))


LATE_INTERACTION = f"""WITH {_VECTORS}, qt AS (SELECT vec_id, i, v[i * 16 + 1:i * 16 + 16] AS v FROM q, range(4) t(i)), et AS (SELECT vec_id, i, v[i * 16 + 1:i * 16 + 16] AS v FROM e, range(4) t(i)),
m AS (SELECT qt.vec_id AS query_id, qt.i, et.vec_id AS doc_id, greatest(max({_cos('qt.v', 'et.v')}), 0) AS best FROM qt, et GROUP BY ALL), s AS (SELECT query_id, doc_id, sum(best) AS score FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 5"""


def matryoshka(spark: SparkSession, sf: str) -> DataFrame:
    rows, asked = (dense.truncated(d, 16) for d in _vectors(spark, sf))
    return dense.topk(rows, asked, 10, skip_self=True).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


MATRYOSHKA = f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {_cos('q.v[1:16]', 'e.v[1:16]')} AS score FROM q, e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""


def binary_hamming(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of each query by differing sign bits."""
    rows, asked = _vectors(spark, sf)
    codes, own = rows.select("doc_id", dense.sign_bits(F.col("vector")).alias("code")), asked.select("query_id", dense.sign_bits(F.col("vector")).alias("own"))
    met = codes.crossJoin(F.broadcast(own)).where("doc_id <> query_id")  # a stated query set against all rows
    near = rank.ranked(met.select("query_id", "doc_id", (-dense.hamming(F.col("code"), F.col("own"))).cast("double").alias("score")), 10)
    return near.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), (-F.col("score")).cast("long").alias("bits"))


BINARY_HAMMING = f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, len(list_filter(range(1, 65), lambda i: (q.v[i] > 0) <> (e.v[i] > 0))) AS bits FROM q, e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bits, doc_id)::INT AS rank FROM s) SELECT query_id, doc_id, rank, bits FROM r WHERE rank <= 10"""


def mmr_diverse(spark: SparkSession, sf: str) -> DataFrame:
    """Two of each query's pool of ten: the best, and the one that adds most to it."""
    rows, asked = _vectors(spark, sf)
    pool = dense.topk(rows, asked, 10, skip_self=True).select("query_id", "doc_id", "score")
    return selection.diverse(pool, rows, 2).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


MMR_DIVERSE = f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM p), t AS (SELECT * FROM r WHERE rank <= 10),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7::DOUBLE * score, 9) DESC, doc_id) AS place FROM t) WHERE place = 1),
b AS (SELECT t.*, 0.7::DOUBLE * t.score - 0.3::DOUBLE * {_cos('x.v', 'y.v')} AS gain FROM t JOIN a ON a.query_id = t.query_id AND a.doc_id <> t.doc_id JOIN e x ON x.vec_id = a.doc_id JOIN e y ON y.vec_id = t.doc_id),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(gain, 9) DESC, doc_id) AS place FROM b)
SELECT query_id, doc_id, 1::INT AS rank, round(score, 6) AS score FROM a UNION ALL SELECT query_id, doc_id, 2::INT, round(score, 6) FROM c WHERE place = 1"""


def core_set(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _vectors(spark, sf)
    return selection.core_set(rows, 3).select("doc_id", "rank", F.round("distance", 6).alias("distance"))


CORE_SET = f"""WITH {_VECTORS}, a AS (SELECT * FROM e ORDER BY vec_id LIMIT 1), d1 AS (SELECT e.*, 1 - {_cos('a.v', 'e.v')} AS d FROM a, e), b AS (SELECT * FROM d1 ORDER BY round(d, 9) DESC, vec_id LIMIT 1),
d2 AS (SELECT d1.vec_id, least(d1.d, 1 - {_cos('b.v', 'd1.v')}) AS d FROM b, d1), c AS (SELECT * FROM d2 ORDER BY round(d, 9) DESC, vec_id LIMIT 1)
SELECT vec_id AS doc_id, 1::INT AS rank, 0.0::DOUBLE AS distance FROM a UNION ALL SELECT vec_id, 2, round(d, 6) FROM b UNION ALL SELECT vec_id, 3, round(d, 6) FROM c"""


def uncertain_first(spark: SparkSession, sf: str) -> DataFrame:
    """The ten queries to label next: those least sure."""
    return selection.uncertain(_observed(spark, sf), 10).select("query_id", "confidence")


UNCERTAIN_FIRST = f"{_SEEN} SELECT query_id, confidence FROM o ORDER BY confidence, query_id LIMIT 10"


def _members(spark: SparkSession, sf: str) -> list[DataFrame]:
    rows, asked = _vectors(spark, sf)
    return [dense.topk(dense.truncated(rows, d), dense.truncated(asked, d), 10, skip_self=True).select("query_id", "doc_id", "score") for d in (64, 32, 16)]


_MEMBERS = f"""WITH {_VECTORS}, mp AS ({' UNION ALL '.join(f"SELECT {d} AS m, q.vec_id AS query_id, e.vec_id AS doc_id, {_cos(f'q.v[1:{d}]', f'e.v[1:{d}]')} AS score FROM q, e WHERE q.vec_id <> e.vec_id" for d in (64, 32, 16))}),
mr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM mp) WHERE rank <= 10)"""


def disputed_first(spark: SparkSession, sf: str) -> DataFrame:
    """The ten queries on which three encoders agree least."""
    return selection.disputed(_members(spark, sf), 10).select("query_id", "choices", F.round("entropy", 6).alias("entropy"))


DISPUTED_FIRST = f"""{_MEMBERS}, c AS (SELECT query_id, doc_id, count(*)::DOUBLE AS c FROM mr WHERE rank = 1 GROUP BY ALL), t AS (SELECT query_id, count(*) AS choices, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM c GROUP BY query_id)
SELECT query_id, choices, round(entropy, 6) AS entropy FROM t ORDER BY round(t.entropy, 9) DESC, query_id LIMIT 10"""


def committee_votes(spark: SparkSession, sf: str) -> DataFrame:
    return rank.committee(_members(spark, sf), 10).select("query_id", "doc_id", "votes", F.round("mean_score", 6).alias("mean_score"))


COMMITTEE_VOTES = f"{_MEMBERS} SELECT query_id, doc_id, count(*) FILTER (rank = 1) AS votes, round(sum(score) / 3, 6) AS mean_score FROM mr GROUP BY ALL"


def rrf_three(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion of three members."""
    return rank.fused(_members(spark, sf), 5, 10).select("query_id", "doc_id", F.round("rrf", 8).alias("rrf"), F.col("rank").cast("int").alias("rank"))


RRF_THREE = f"""{_MEMBERS}, f AS (SELECT query_id, doc_id, sum(1 / (60 + rank)::DOUBLE) AS rrf, min((CASE m WHEN 64 THEN 0 WHEN 32 THEN 1 ELSE 2 END) * 100 + rank) AS met FROM mr GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, met, doc_id)::INT AS rank FROM f) SELECT query_id, doc_id, round(rrf, 8) AS rrf, rank FROM r WHERE rank <= 5"""


def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of every tenth vector spread for two rounds over the five nearest of every twentieth."""
    rows, asked = _vectors(spark, sf)
    edges = dense.topk(rows, asked, 5, skip_self=True).select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"), F.col("score").alias("weight"))
    seeds = rows.where("doc_id % 10 = 0").select(F.col("doc_id").alias("node"), "label")
    return selection.propagated(edges, seeds, 2)


LABEL_PROPAGATION = f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p),
b AS (SELECT query_id AS a, doc_id AS b, score AS w FROM r WHERE rank <= 5 UNION ALL SELECT doc_id, query_id, score FROM r WHERE rank <= 5), l0 AS (SELECT vec_id AS node, label FROM e WHERE vec_id % 10 = 0),
v1 AS (SELECT a AS node, label, round(sum(w), 9) AS w FROM b JOIN l0 ON node = b.b GROUP BY ALL),
l1 AS (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, label) AS k FROM v1) WHERE k = 1 AND node NOT IN (SELECT node FROM l0) UNION ALL SELECT * FROM l0),
v2 AS (SELECT a AS node, label, round(sum(w), 9) AS w FROM b JOIN l1 ON node = b.b GROUP BY ALL)
SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, label) AS k FROM v2) WHERE k = 1 AND node NOT IN (SELECT node FROM l0) UNION ALL SELECT * FROM l0"""


_PLAIN = (
    knn_density, mahalanobis, conformal_threshold, temperature, abstention_scores, rank_metrics, krippendorff_alpha, rocchio_feedback, max_field, late_interaction, matryoshka, binary_hamming,
    mmr_diverse, core_set, uncertain_first, disputed_first, committee_votes, rrf_three, label_propagation,
)
QUERIES = {"vote_mean": _vote("mean"), "vote_softmax": _vote("softmax"), **{f.__name__: f for f in _PLAIN}}
ORACLE = {name: globals()[name.upper()] for name in QUERIES}
