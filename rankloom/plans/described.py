"""Queries over a described corpus made of the conversations: each is a document, its user turns are its example tasks.

The assistant's turns are its concepts, the system's its intents, the last turn its reasoning, and the label of the
document with the same number its prior. Queries are held-out examples, poor matches (the first user turn of the next
conversation), gibberish and an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom import methods
from rankloom.operators import evaluation as ev, metrics

SAMPLE, K = 40, 10


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id is not null and text is not null")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"])
    rows = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(
        of("assistant").alias("visual_concepts"), of("system").alias("task_intents"), of("user").alias("example_tasks"), F.max_by("text", F.struct("turn", "text")).alias("reasoning"))
    prior = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").cast("double").alias("prior"))
    nxt = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.slice("example_tasks", 1, 1).alias("poor_matches"))
    none = F.array().cast("array<string>")
    made = rows.join(prior, "doc_id", "left").join(nxt, "doc_id", "left").select(
        "doc_id", F.coalesce("prior", F.lit(0.0)).alias("prior"), "visual_concepts", "task_intents", "example_tasks", F.coalesce("poor_matches", none).alias("poor_matches"), "reasoning",
        F.substring("reasoning", 1, 1).alias("char"))
    return made


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = corpus(spark, sf).persist()
    positives, poor = (d.persist() for d in ev.build(docs, SAMPLE))
    return docs, positives.withColumn("query_id", F.concat(F.lit("p"), "query_id")), poor.withColumn("query_id", F.concat(F.lit("n"), "query_id"))


def _asked(spark: SparkSession, positives: DataFrame, poor: DataFrame) -> DataFrame:
    return positives.select("query_id", "text").unionByName(poor.select("query_id", "text")).unionByName(ev.silly(spark))


_TOKENS = "regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')"


def _vector(text: str) -> str:
    return f"list_transform(range(64), lambda i: len(list_filter({_TOKENS.format(t=text)}, lambda t: ('0x' || substr(md5(t), 1, 4))::INT % 64 = i))::DOUBLE)"


def _cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / ((CASE WHEN list_inner_product({a}, {a}) = 0 THEN 1 ELSE sqrt(list_inner_product({a}, {a})) END) * (CASE WHEN list_inner_product({b}, {b}) = 0 THEN 1 ELSE sqrt(list_inner_product({b}, {b})) END))"


_GIBBERISH = ", ".join(f"('g{i}', '{t}')" for i, t in enumerate(ev.GIBBERISH))
_SETS = f"""
c0 AS (SELECT conv_id AS doc_id, coalesce(list(text ORDER BY turn, text) FILTER (role = 'assistant'), []) AS vc, coalesce(list(text ORDER BY turn, text) FILTER (role = 'system'), []) AS ti,
              coalesce(list(text ORDER BY turn, text) FILTER (role = 'user'), []) AS ex, arg_max(text, (turn, text)) AS re FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL GROUP BY conv_id),
pr AS (SELECT doc_id, max(quality)::DOUBLE AS prior FROM labels GROUP BY doc_id),
co AS (SELECT c0.*, coalesce(prior, 0) AS prior, nx.ex[1] AS poor FROM c0 LEFT JOIN pr USING (doc_id) LEFT JOIN c0 nx ON nx.doc_id = c0.doc_id + 1),
ch AS (SELECT *, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT AS num FROM co WHERE prior >= 0.6 AND len(ex) >= 2 ORDER BY md5('0:' || doc_id), doc_id LIMIT {SAMPLE}),
pos AS (SELECT 'p' || doc_id AS query_id, ex[num % len(ex) + 1] AS text, doc_id AS gold FROM ch),
neg AS (SELECT 'n' || doc_id AS query_id, poor AS text, doc_id AS bad FROM ch WHERE poor IS NOT NULL),
qs AS (SELECT query_id, text FROM pos UNION ALL SELECT query_id, text FROM neg UNION ALL SELECT * FROM (VALUES {_GIBBERISH}) g(query_id, text))
"""


def _scored(examples: bool) -> str:
    """Scores of all methods of all queries and documents; ``examples``: documents hold them and M2 keeps all."""
    fields = [("vc", 0.5, "array_to_string(vc, ', ')"), ("ti", 1.0, "array_to_string(ti, ', ')"), *[("ex", 1.0, "array_to_string(ex, ', ')")] * examples, ("re", 0.3, "re")]
    whole = ", ".join(f"nullif({t}, '')" for _, _, t in fields)
    total = sum(w for _, w, _ in fields)
    m1 = " + ".join(f"{w}::DOUBLE * {_cos('q.v', f'd.v_{n}')}" for n, w, _ in fields)
    held = "" if examples else "WHERE text NOT IN (SELECT text FROM pos)"
    return f"""
dx AS (SELECT doc_id, prior, concat_ws('. ', {whole}) AS text, {', '.join(f"{_vector(t)} AS v_{n}" for n, _, t in fields)} FROM co),
dv AS (SELECT *, {_vector('text')} AS v FROM dx), qv AS (SELECT query_id, text, {_vector('text')} AS v FROM qs),
dt AS (SELECT doc_id, {_TOKENS.format(t='text')} AS terms FROM dx), st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM dt),
tf AS (SELECT doc_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format(t='text')}) AS term FROM qs) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS x FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY ALL),
ex AS (SELECT doc_id, text, {_vector('text')} AS v FROM (SELECT doc_id, unnest(ex) AS text FROM co) {held}),
m2 AS (SELECT query_id, doc_id, greatest(max({_cos('qv.v', 'ex.v')}), 0) AS x FROM qv, ex GROUP BY ALL),
s AS (SELECT 'B0' AS method, q.query_id, d.doc_id, {_cos('q.v', 'd.v')} AS score FROM qv q, dv d
      UNION ALL SELECT 'B1', q.query_id, d.doc_id, CASE WHEN x > 0 THEN x / (x + 8) ELSE 0 END FROM qv q CROSS JOIN dv d LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = d.doc_id
      UNION ALL SELECT 'M1', q.query_id, d.doc_id, ({m1}) / {total}::DOUBLE + 0.05::DOUBLE * prior FROM qv q, dv d
      UNION ALL SELECT 'M2', q.query_id, d.doc_id, coalesce(x, 0) + 0.05::DOUBLE * prior FROM qv q CROSS JOIN dv d LEFT JOIN m2 ON m2.query_id = q.query_id AND m2.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
f AS (SELECT query_id, doc_id, sum(1 / (60 + rank)::DOUBLE) AS rrf, greatest(max(score), 0) AS score, min(CASE WHEN method = 'B1' THEN rank ELSE 1000 + rank END) AS met FROM r WHERE method IN ('B1', 'M1') AND rank <= 50 GROUP BY ALL),
top AS (SELECT method, query_id, doc_id, score, rank FROM r UNION ALL SELECT 'M3', query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, met) FROM f),
z AS (SELECT method, query_id, CASE WHEN stddev_pop(score) <= 1e-9 THEN 0 ELSE (max(score) - avg(score)) / stddev_pop(score) END AS confidence FROM s GROUP BY ALL),
conf AS (SELECT * FROM z UNION ALL SELECT 'M3', query_id, max(confidence) FROM z WHERE method IN ('B1', 'M1') GROUP BY query_id)
"""


def method_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five best of every query by each method, without a way to the answers."""
    docs, positives, poor = _sets(spark, sf)
    asked, out = _asked(spark, positives, poor), None
    for key, method in ev.leak_free(methods.KEYS, docs, positives).items():
        part = method.pool(asked, 5).top.select(F.lit(key).alias("method"), "query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.bround("score", 4).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


METHOD_TOPK = f"WITH {_SETS}, {_scored(False)} SELECT method, query_id, doc_id, rank::INT AS rank, round_even(score, 4) AS score FROM top WHERE rank <= 5"


def method_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A decision for every query by each method."""
    docs, positives, poor = _sets(spark, sf)
    asked, out = _asked(spark, positives, poor), None
    for key, method in ev.leak_free(methods.KEYS, docs, positives).items():
        made = methods.decide(method, asked)
        part = made.select(F.lit(key).alias("method"), "query_id", "doc_id", F.bround("score", 4).alias("score"), F.bround("confidence", 3).alias("confidence"), "shown")
        out = part if out is None else out.unionByName(part)
    return out


METHOD_GATE = f"""WITH {_SETS}, {_scored(False)} SELECT method, query_id, doc_id, round_even(score, 4) AS score, round_even(confidence, 3) AS confidence, confidence >= 3.6 AS shown
FROM top JOIN conf USING (method, query_id) WHERE rank = 1"""


def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The shortlist of the default method, with glyphs, for held-out texts, gibberish and an empty text."""
    docs, positives, poor = _sets(spark, sf)
    asked = _asked(spark, positives, poor).unionByName(spark.createDataFrame([("empty", "  ")], "query_id string, text string"))
    found = methods.search(docs, asked, "no such method", 3)
    return found.select("query_id", "method", "decision_id", "shown", "confidence", "reason", F.explode_outer("hits").alias("h")).select(
        "query_id", "method", "decision_id", "shown", "confidence", "reason", F.col("h.rank").cast("int").alias("rank"), "h.doc_id", "h.score", "h.char", F.col("h.shown").alias("hit_shown"))


SEARCH_HITS = f"""WITH {_SETS}, {_scored(True)} SELECT query_id, 'M3' AS method, CASE WHEN confidence >= 3.6 THEN first_value(doc_id) OVER w END AS decision_id, confidence >= 3.6 AS shown,
  round_even(confidence, 3) AS confidence, CASE WHEN confidence >= 3.6 THEN 'shown' ELSE printf('confidence %.3f < threshold 3.600', confidence) END AS reason,
  rank::INT AS rank, doc_id, round_even(score, 4) AS score, substr(re, 1, 1) AS char, rank = 1 AND confidence >= 3.6 AS hit_shown
FROM top JOIN conf USING (method, query_id) JOIN co USING (doc_id) WHERE method = 'M3' AND rank <= 3 WINDOW w AS (PARTITION BY query_id ORDER BY rank)
UNION ALL SELECT 'empty', 'M3', NULL, false, 0, 'empty query', NULL, NULL, NULL, NULL, NULL"""


def holdout_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the examples once the held-out queries are gone."""
    docs, positives, _ = _sets(spark, sf)
    examples = docs.select("doc_id", F.posexplode("example_tasks").alias("place", "text"))
    return ev.without_held_out(examples, positives).select("doc_id", "place")


HOLDOUT_EXCLUSION = f"WITH {_SETS} SELECT doc_id, (i - 1)::INT AS place FROM co, unnest(range(1, len(ex) + 1)) t(i) WHERE ex[i] NOT IN (SELECT text FROM pos)"


def _report(spark: SparkSession, sf: str, keys: tuple[str, ...] = methods.KEYS) -> DataFrame:
    docs, positives, poor = _sets(spark, sf)
    return ev.report(ev.leak_free(keys, docs, positives), positives, poor, K)


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    made = _report(spark, sf)
    return made.select("method", "n_queries", *[F.round(c, 6).alias(c) for c in made.columns if c not in ("method", "n_queries", "gate_auroc")], F.bround("gate_auroc", 4).alias("gate_auroc"))


_REPORT = f"""{_SETS}, {_scored(False)},
j AS (SELECT t.method, p.query_id, round(c.confidence, 9) AS confidence, min(CASE WHEN t.doc_id = p.gold AND t.rank <= {K} THEN t.rank END) AS rank FROM pos p JOIN top t USING (query_id) JOIN conf c USING (method, query_id) GROUP BY ALL),
jc AS (SELECT *, coalesce((rank = 1)::INT, 0) AS correct, row_number() OVER (PARTITION BY method ORDER BY confidence DESC, query_id) AS place, count(*) OVER (PARTITION BY method) AS n FROM j),
g AS (SELECT method, confidence AS s, correct AS y FROM jc UNION ALL SELECT method, round(confidence, 9), 0 FROM conf WHERE query_id[1] = 'g'),
au AS (SELECT a.method, avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) AS auroc FROM g a JOIN g b ON a.method = b.method AND a.y = 1 AND b.y = 0 GROUP BY a.method),
su AS (SELECT method, avg((doc_id <> bad)::INT::DOUBLE) AS suppression FROM neg JOIN top USING (query_id) WHERE rank = 1 GROUP BY method),
rep AS (SELECT method, avg(correct::DOUBLE) AS precision_at_1, avg((rank IS NOT NULL)::INT::DOUBLE) AS recall_at_k, avg(coalesce(1 / rank::DOUBLE, 0)) AS mrr, avg(coalesce(1 / log2(rank + 1), 0)) AS ndcg_at_k, count(*) AS n_queries,
  {', '.join(f"sum(correct) FILTER (place <= greatest(1, round_even({c}::DOUBLE * n, 0))) / greatest(1, round_even({c}::DOUBLE * max(n), 0)) AS precision_at_{round(100 * c)}" for c in (0.5, 0.7, 0.9))} FROM jc GROUP BY method)"""
_NAMES = ("precision_at_1", "recall_at_k", "mrr", "ndcg_at_k", "precision_at_50", "precision_at_70", "precision_at_90")
EVALUATION_REPORT = f"""WITH {_REPORT} SELECT rep.method, n_queries, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)}, round(suppression, 6) AS poor_match_suppression, round_even(auroc, 4) AS gate_auroc
FROM rep LEFT JOIN au USING (method) LEFT JOIN su USING (method)"""


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """As printed, of the lexical method and the nearest example."""
    made = _report(spark, sf, ("B1", "M2"))
    return metrics.leaderboard(made.select("method", *[F.round(c, 9).alias(c) if c != "n_queries" else c for c in made.columns if c != "method"]))


_BOARD = (*_NAMES, "poor_match_suppression", "gate_auroc")
LEADERBOARD = f"""WITH {_REPORT}, w AS (SELECT rep.*, suppression AS poor_match_suppression, auroc AS gate_auroc FROM rep LEFT JOIN au USING (method) LEFT JOIN su USING (method) WHERE rep.method IN ('B1', 'M2'))
SELECT method, unnest({list(_BOARD)}) AS metric, unnest([{', '.join(f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE printf('%.3f', round({c}, 9)) END" for c in _BOARD)}]) AS value FROM w
UNION ALL SELECT method, 'n_queries', n_queries::VARCHAR FROM w"""


def stratified_report(spark: SparkSession, sf: str) -> DataFrame:
    """(fold, n, mean, deviation) of the reciprocal rank by M2, over folds stratified by the length of the text."""
    from rankloom.operators import selection

    docs, positives, _ = _sets(spark, sf)
    method = ev.leak_free(("M2",), docs, positives)["M2"]
    seen = ev.judged(method, positives, K).join(positives.select("query_id", (F.length("text") > 80).alias("long")), "query_id")
    dealt = selection.folds(seen.withColumn("rr", F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), "query_id", "long", 4)
    made = selection.per_split(dealt, "fold", "rr")
    return made.select("fold", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


STRATIFIED_REPORT = f"""WITH {_REPORT}, d AS (SELECT ('0x' || substr(md5('0:' || (length(text) > 80) || chr(0) || query_id), 1, 8))::BIGINT % 4 AS fold, coalesce(1 / rank::DOUBLE, 0) AS rr FROM jc JOIN pos USING (query_id) WHERE method = 'M2')
SELECT fold::INT AS fold, count(*) AS n, round(avg(rr), 6) AS mean, round(stddev_pop(rr), 6) AS deviation FROM d GROUP BY fold"""


QUERIES = {f.__name__: f for f in (method_topk, method_gate, search_hits, holdout_exclusion, evaluation_report, leaderboard, stratified_report)}
ORACLE = {
    "method_topk": METHOD_TOPK, "method_gate": METHOD_GATE, "search_hits": SEARCH_HITS, "holdout_exclusion": HOLDOUT_EXCLUSION, "evaluation_report": EVALUATION_REPORT, "leaderboard": LEADERBOARD,
    "stratified_report": STRATIFIED_REPORT,
}
