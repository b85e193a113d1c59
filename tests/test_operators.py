import math
import random

import pytest

from rankloom import methods
from rankloom.operators import dense, encode, evaluation as ev, gate as g, lexical, metrics, outliers, rank, selection

DOCS = [(1, "red fox red"), (2, "blue fox"), (3, "green tree house"), (4, ""), (5, None)]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(1, "fox fox red"), (2, "nothing here"), (3, None)], "query_id long, text string")


def bm25(query, docs):
    terms = [(t or "").split() for _, t in docs]
    n, avg = len(docs), sum(map(len, terms)) / len(docs)
    df = {}
    for t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    return {d: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()) for (d, _), t in zip(docs, terms) if set(t) & set(query.split())}


def test_bm25(spark):
    docs, queries = frames(spark)
    got = {(r.query_id, r.doc_id): r.score for r in lexical.score(docs, queries).collect()}
    want = bm25("fox fox red", DOCS)
    assert got.keys() == {(1, d) for d in want} and all(abs(got[1, d] - s) < 1e-12 for d, s in want.items())


def test_sparse_confidence_is_the_dense_one(spark):
    rng = random.Random(0)
    rows = [(q, d, rng.random()) for q in range(5) for d in range(rng.randint(1, 9))]
    got = {r.query_id: r.confidence for r in rank.confidence(spark.createDataFrame(rows, "query_id long, doc_id long, score double"), 12).collect()}
    for q in range(5):
        s = [x for a, _, x in rows if a == q]
        s += [0.0] * (12 - len(s))
        m = sum(s) / 12
        assert abs(got[q] - (max(s) - m) / math.sqrt(sum((x - m) ** 2 for x in s) / 12)) < 1e-9


def test_ranking_and_fusion(spark):
    a = spark.createDataFrame([(1, d, s) for d, s in [(1, 0.5), (2, 0.5), (3, 0.9)]], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, d, s) for d, s in [(2, 0.8), (4, -0.1)]], "query_id long, doc_id long, score double")
    assert [r.doc_id for r in rank.ranked(a, 3).orderBy("rank").collect()] == [3, 1, 2]
    fused = rank.fused([a, b], 10).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [2, 3, 1, 4] or [r.doc_id for r in fused][:2] == [2, 3]
    assert {r.doc_id: r.score for r in fused}[4] == 0.0
    with pytest.raises(ValueError):
        rank.ranked(a, 0)


def test_gate_keeps_every_query(spark):
    docs, queries = frames(spark)
    scores = lexical.saturated(lexical.score(docs, queries))
    got = {r.query_id: r for r in g.Gate(0.5).decide(queries, rank.ranked(scores, 1), rank.confidence(scores, docs.count())).collect()}
    assert got[1].shown and got[1].reason == "shown" and got[2].reason == "no candidates" and got[3].doc_id is None and not got[3].shown
    low = g.Gate(0.9, 1.0, -20.0).decide(queries, rank.ranked(scores, 1), rank.confidence(scores, docs.count())).where("query_id = 1").first()
    assert not low.shown and low.reason == "prob 0.000 < threshold 0.900" and low.doc_id is not None


@pytest.mark.parametrize("seed", range(3))
def test_metrics_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 6) / 6, rng.randint(0, 1)) for i in range(41)]
    seen = spark.createDataFrame(rows, "query_id long, score double, label int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(metrics.auroc(seen).first()["auroc"] - want) < 1e-9
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.coverage: r.precision for r in metrics.precision_at_coverage(seen.selectExpr("query_id", "score as confidence", "label as correct")).collect()}
    assert all(abs(got[c] - sum(y for *_, y in order[: max(1, round(c * 41))]) / max(1, round(c * 41))) < 1e-9 for c in (0.5, 0.7, 0.9))
    p = metrics.percentiles(seen, "score").first()
    assert p.p95 == sorted(s for _, s, _ in rows)[max(0, int(0.95 * 41) - 1)]
    assert metrics.auroc(seen.where("label = 1")).first()["auroc"] is None


def test_dense(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 2.0], 7), (3, [3.0, 3.0], 8), (4, [0.0, 0.0], 8)], "doc_id long, vector array<double>, owner int")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 1.0])], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 6)) for r in dense.topk(c, q, 2, skip_self=True).collect()}
    assert got[1, 1] == (3, 0.707107) and got[9, 1] == (2, 1.0) and got[9, 2] == (3, 0.707107)
    best = {(r.query_id, r.owner): round(r.score, 6) for r in dense.grouped(c, q, "owner").collect()}
    assert best == {(1, 7): 0.0, (1, 8): 0.707107, (9, 7): 1.0, (9, 8): 0.707107}


def test_dense_leaves_out_vectors_it_cannot_compare(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [0.0, 1.0, 9.0], [5.0], None, [nan, 1.0], [inf, 0.0], [1.0, None], [], [0.0, 0.0], [-1e200, 1e200], [1e-200, 0.0]]
    c = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "doc_id int, vector array<double>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [1.0, nan])], "query_id string, vector array<double>")
    got = [(r.query_id, r.doc_id, round(r.score, 6)) for r in dense.topk(c, q, 9).orderBy("rank").collect()]
    assert got == [("a", 0, 1.0), ("a", 10, 1.0), ("a", 8, 0.0), ("a", 9, -0.707107)]
    assert dense.topk(c, q.where("query_id = 'b'"), 3).count() == 0
    assert dense.sums(c, q).count() == 1
    named = spark.createDataFrame([("x", [1.0, 0.0]), ("w", [2.0, 0.0])], "doc_id string, vector array<double>")
    assert [r.doc_id for r in dense.topk(named, q, 2).orderBy("rank").collect()] == ["w", "x"]
    with pytest.raises(ValueError):
        dense.topk(c, spark.createDataFrame([("a", [2.0]), ("b", [1.0, 2.0])], "query_id string, vector array<double>"), 1)


def test_platt_pulls_apart(spark):
    seen = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "confidence double, correct int")
    gate = g.platt(seen, 0.5)
    assert gate.a > 0 and g.platt(seen.where("correct = 1"), 0.5).a is None


def described(spark):
    rows = [(i, 0.8, [f"topic{i} word{i}"], ["do it"], [f"topic{i} first", f"second{i} again"], [f"topic{(i + 1) % 20} other"], f"because {i}", chr(65 + i)) for i in range(20)]
    rows.append((20, 1.0, [], [], [], [], "", "z"))
    return spark.createDataFrame(rows, "doc_id long, prior double, visual_concepts array<string>, task_intents array<string>, example_tasks array<string>, poor_matches array<string>, reasoning string, char string")


def test_evaluation(spark):
    corpus = described(spark)
    positives, poor = ev.build(corpus, 10)
    assert positives.count() == 10 and poor.count() == 10
    first = positives.collect()
    hits = sum(r.text.startswith("topic") for r in first)  # the other examples share no word with their documents
    method = ev.leak_free(("B1",), corpus, positives)["B1"]
    row = ev.evaluate(method, positives, poor).first()
    zero = sum(not r.text.startswith("topic") and r.doc_id == 0 for r in first)  # without any match the smallest id is the best
    assert row.precision_at_1 == (hits + zero) / 10 and row.poor_match_suppression == 1.0 and row.n_queries == 10
    # a wrong best match is a 0 as gibberish is
    seen = {r.query_id: r for r in ev.judged(method, positives, 10).collect()}
    assert {q for q, r in seen.items() if r.correct} == {r.query_id for r in first if r.text.startswith("topic") or r.doc_id == 0}
    right, wrong = [r.confidence for r in seen.values() if r.correct], [r.confidence for r in seen.values() if not r.correct] + [0.0] * 6
    want = sum((a > b) + 0.5 * (a == b) for a in right for b in wrong) / (len(right) * len(wrong))
    assert abs(row.gate_auroc - want) < 1e-9 and 0 < len(right) < 10
    left = ev.without_held_out(spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), spark.createDataFrame([("a",)], "text string"))
    assert [r.text for r in left.collect()] == ["b"]
    assert ev.latencies(method, positives.limit(2)).where("ms > 0").count() == 2
    assert metrics.markdown(ev.report({"B1": method}, positives, poor)).split("\n")[2].startswith("| B1 | ")


def test_methods_and_search(spark):
    corpus = described(spark)
    asked = spark.createDataFrame([(1, "topic3 first"), (2, "   "), (3, None), (4, "qqq")], "query_id long, text string")
    for key in methods.KEYS:
        top = methods.build(key, corpus).pool(asked.where("query_id = 1"), 3).top.orderBy("rank").collect()
        assert len(top) == 3 and top[0].doc_id == 3, key
    with pytest.raises(KeyError):
        methods.build("X", corpus)
    found = {r.query_id: r for r in methods.search(corpus, asked, "X", "many").collect()}
    assert found[1].method == "M3" and len(found[1].hits) == 12 and found[1].hits[0].char == "D" and found[2].hits == [] and found[3].reason == "empty query"
    assert found[4].hits[0].rank == 1 and not found[4].shown and found[4].decision_id is None
    # the document without examples has its prior's share alone, and is there
    m2 = methods.build("M2", corpus).pool(asked.where("query_id = 4"), 30).top.collect()
    assert len(m2) == 21 and {r.doc_id: round(r.score, 9) for r in m2}[20] == 0.05
    held = corpus.selectExpr("explode(example_tasks) as text")
    assert {round(r.score, 9) for r in methods.build("M2", corpus, held_out=held).pool(asked.where("query_id = 1"), 30).top.collect()} == {0.04, 0.05}
    assert methods.Settings.from_env({"RANKLOOM_ABSTAIN_THRESHOLD": "2"}).threshold == 2.0
    assert methods.build("M1", corpus, include_examples=False).names == ["visual_concepts", "task_intents", "reasoning"]


def test_vectors_are_kept_by_content(spark, tmp_path):
    made = []
    encoder = encode.Encoder("some-e5-model", lambda text: made.append(1) or encode.hashing(4).encode(text))
    cache = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    first = {r.doc_id: r.vector for r in encode.vectors(rows, encoder, cache=cache).collect()}
    assert first[1] == first[2] and spark.read.parquet(cache).count() == 2
    again = encode.vectors(rows.unionByName(spark.createDataFrame([(4, "edited")], "doc_id long, text string")), encoder, cache=cache)
    assert {r.doc_id: r.vector for r in again.collect() if r.doc_id < 4} == first and spark.read.parquet(cache).count() == 3
    assert encode.prefix("intfloat-E5", False) == "passage: " and encode.prefix("bge-x", False) == "" and encode.prefix("other", True) == ""
    model = encode.model("m", lambda: lambda texts: [[float(len(t))] for t in texts])
    assert [r.vector for r in encode.vectors(rows, model).orderBy("doc_id").collect()] == [[3.0], [3.0], [0.0]]


def test_transport_and_groups(spark):
    x = [[1.0, 0.0], [0.0, 1.0]]
    pairs = spark.createDataFrame([(1, 1, x, x), (1, 2, x, [[0.0, -1.0], [-1.0, 0.0]]), (1, 3, x, [])], "query_id long, doc_id long, xs array<array<double>>, ys array<array<double>>")
    cost = {r.doc_id: r.cost for r in outliers.transport(pairs).collect()}
    assert cost[1] < 1e-6 and abs(cost[2] - 1.0) < 1e-3 and cost[3] is None
    c = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "doc_id long, vector array<double>")
    assert [r.doc_id for r in selection.core_set(c, 9).orderBy("rank").collect()] == [0, 1, 2, 3]
    seen = spark.createDataFrame([(i, float(i), 1) for i in range(9)], "query_id long, confidence double, correct int")
    assert outliers.conformal(seen, 0.2).first()["threshold"] == 1.0 and outliers.conformal(seen, 0.01).first()["threshold"] is None
    values = spark.createDataFrame([(float(i % 7), 1) for i in range(50)], "v double, c long").groupBy("v").sum("c").toDF("v", "c")
    got = {r.v: r.upto_c for r in metrics.running(values, "v", ["c"]).collect()}
    assert got == {float(v): sum(1 for i in range(50) if i % 7 <= v) for v in range(7)}
