"""What a task holds and gives back is bounded, and the results are those of comparing everything with everything."""

import hashlib
import random

import numpy as np
import pytest

from rankloom import methods
from rankloom.operators import dense, encode, lexical, metrics, rank


@pytest.fixture
def small_batches(spark):
    """Several Arrow batches a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    yield
    spark.conf.set(key, before)


def ranked_rows(monkeypatch, module):
    """Gets the number of rows that each call of ``ranked`` is given."""
    seen, plain = [], module.ranked
    monkeypatch.setattr(module, "ranked", lambda df, *a, **b: seen.append(df.count()) or plain(df, *a, **b))
    return seen


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)))


def vectors(n, seed, dim=3):
    rng = random.Random(seed)
    return [[float(rng.randint(-2, 2)) for _ in range(dim)] for _ in range(n)]  # many ties


def first(scores, k):
    return sorted(scores, key=lambda x: (-round(x[1], 9), x[0]))[:k]


def test_a_task_gives_back_the_best_of_all_its_batches(spark, small_batches, monkeypatch):
    docs, asked = vectors(400, 1), vectors(12, 2)
    c = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(docs)], "doc_id long, vector array<double>, label int").coalesce(1)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    seen = ranked_rows(monkeypatch, dense)
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in dense.topk(c, q, 4, skip_self=True).collect()}
    assert seen == [48]
    for i, v in enumerate(asked):
        for place, (d, s) in enumerate(first([(j, cosine(v, x)) for j, x in enumerate(docs) if j != i], 4), 1):
            assert got[i, place][0] == d and abs(got[i, place][1] - s) < 1e-8
    for how in ("max", "mean", "softmax"):
        votes = {(r.query_id, r.owner): r.score for r in dense.grouped(c, q, "label", how).collect()}
        assert len(votes) == 36
        for (i, label), score in votes.items():
            s = [cosine(asked[i], x) for j, x in enumerate(docs) if j % 3 == label and j != i]
            assert abs(score - {"max": max(*s, 0.0), "mean": np.mean(s), "softmax": np.log(np.mean(np.exp(s)))}[how]) < 1e-9
    sure = {r.query_id: r.confidence for r in dense.sums(c, q).collect()}
    for i, v in enumerate(asked):
        s = np.array([cosine(v, x) for x in docs])
        assert abs(sure[i] - (0.0 if s.std() <= 1e-9 else (s.max() - s.mean()) / s.std())) < 1e-9


@pytest.mark.parametrize("n, docs", [(1, 1), (4096, 10_000), (30_000, 3), (5, 60_000)])
def test_tiles_are_of_bounded_size_and_whole(n, docs):
    tiles = list(dense._tiles(n, docs))
    assert max((b - a) * (e - c) for a, b, c, e in tiles) <= dense.TILE and sum((b - a) * (e - c) for a, b, c, e in tiles) == n * docs


@pytest.mark.parametrize("block, parts", [(5, 2), (100, 7)])
def test_more_blocks_read_the_corpus_in_fewer_parts(spark, monkeypatch, block, parts):
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "SPLITS", 2)
    docs, asked = vectors(90, 3), vectors(9, 4)
    c = spark.createDataFrame([(i, v) for i, v in enumerate(docs)], "doc_id long, vector array<double>").repartition(7)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    seen = ranked_rows(monkeypatch, dense)
    got = {(r.query_id, r.rank): r.doc_id for r in dense.topk(c, q, 3).collect()}
    assert seen[0] <= 9 * 3 * parts and got == {(i, p): d for i, v in enumerate(asked) for p, (d, _) in enumerate(first([(j, cosine(v, x)) for j, x in enumerate(docs)], 3), 1)}


def test_late_interaction_ranks_where_the_vectors_are(spark, monkeypatch):
    docs, asked = vectors(300, 5), vectors(20, 6)
    owners, owner_of = [i // (1 + i % 4) for i in range(300)], [i // 3 for i in range(20)]
    tokens = spark.createDataFrame(list(zip(owners, docs)) + [(7, None), (9, [float("nan"), 0.0, 0.0])], "owner long, vector array<double>")
    q = spark.createDataFrame(list(zip(owner_of, asked)), "query_id long, vector array<double>")
    seen = ranked_rows(monkeypatch, dense)
    got = {(r.query_id, r.rank): (r.owner, r.score) for r in dense.max_sim(tokens, q, 3).collect()}
    assert seen[0] <= 7 * 3 * 4 and len(got) == 21
    for i in set(owner_of):
        every = [(o, sum(max(0.0, *[cosine(v, x) for x, y in zip(docs, owners) if y == o]) for v, j in zip(asked, owner_of) if j == i)) for o in set(owners)]
        for place, (o, s) in enumerate(first(every, 3), 1):
            assert got[i, place][0] == o and abs(got[i, place][1] - s) < 1e-9


WORDS = "red fox blue tree house green sky".split()


def texts(spark, n, seed, parts):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))), float(rng.randint(0, 1))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None)], "doc_id long, text string, prior double").coalesce(parts)


@pytest.mark.parametrize("how, squash, prior", [("bm25", False, False), ("bm25", True, True), ("tfidf", False, False)])
def test_lexical_scores_are_ranked_where_documents_are_scanned(spark, small_batches, monkeypatch, how, squash, prior):
    docs = texts(spark, 300, 7, 1)
    docs = docs if prior else docs.drop("prior")
    asked = spark.createDataFrame([("a", "red fox fox"), ("b", "sky nothing"), ("c", "none"), ("d", None), ("e", " ".join(WORDS))], "query_id string, text string")
    whole = {"bm25": lexical.score, "tfidf": lexical.tfidf}[how](docs, asked)
    whole = lexical.saturated(whole) if squash else whole
    if prior:
        whole = whole.join(docs, "doc_id").selectExpr("query_id", "doc_id", "score + coalesce(prior, 0) as score")
    rows = lambda df: [(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]
    want, sure = rows(rank.ranked(whole, 4)), {r.query_id: r.confidence for r in rank.confidence(whole, 301).collect()}
    seen = ranked_rows(monkeypatch, dense)
    top, own = lexical.pool(docs, asked, 4, how, squash)
    assert rows(top) == want and len(want) == 12 and seen == [12]
    got = {r.query_id: r.confidence for r in rank.confidence_of(own, 301).collect()}
    assert got.keys() == sure.keys() and all(abs(got[q] - c) < 1e-9 for q, c in sure.items())
    # with more terms than may be broadcast, the same by way of the whole relation
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 3)
    assert rows(lexical.pool(docs, asked, 4, how, squash)[0]) == want


def test_tiles_of_documents_are_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dense, "TILE", 8)
    made = lexical._Postings(3, ["a", "b"], np.array([0, 3, 4]), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 3.0, 5.0]), None, False)
    rows = [["a", "b", "z"], [], None, ["b"], ["a", "a"]] * 3
    made.take(pa.array(rows, pa.list_(pa.string())))
    tiles = list(made.tiles(len(rows)))
    assert [c for c, *_ in tiles] == [0, *[e for _, e, *_ in tiles][:-1]] and tiles[-1][1] == len(rows) and len(tiles) > 3
    s, met = np.hstack([t[2] for t in tiles]), np.hstack([t[3] for t in tiles])
    double = 1 + np.log(2)
    assert np.allclose(s[:, :5], [[1, 0, 0, 0, double], [7, 0, 0, 5, 2 * double], [3, 0, 0, 0, 3 * double]]) and (s[:, :5] == s[:, 5:10]).all() and met[0, :5].tolist() == [True, False, False, False, True]


def described(spark, n=40):
    rows = [(i, 0.8 if i % 2 else None, [f"doc{i} a"], [f"do doc{i}"], [f"topic{i % 7} x{j}" for j in range(i % 4)], f"doc{i} because") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, prior double, visual_concepts array<string>, task_intents array<string>, example_tasks array<string>, reasoning string").coalesce(1)


@pytest.mark.parametrize("key, views", [("B0", 1), ("M1", 4)])
def test_a_text_is_encoded_once_for_ranking_and_confidence(spark, key, views):
    count = spark.sparkContext.accumulator(0)

    def load():
        def vectors(some):
            count.add(len([t for t in some if "doc" in t or "topic" in t or not t]))
            return [[float(len(t)), 1.0] for t in some]

        return vectors

    found = methods.build(key, described(spark), encoder=encode.model("counting", load)).pool(spark.createDataFrame([(1, "ask")], "query_id long, text string"), 3)
    assert found.top.count() == 3 and found.confidence.count() == 1
    assert count.value == 40 * views


def test_hashing_counts_tokens_by_bucket(spark):
    rows = [(1, "Red fox, red FOX x1"), (2, ""), (3, None), (4, "a b c d e f g h i j a a")]
    got = {r.doc_id: r.v for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", encode.hashing(8).encode(dense.F.col("text")).alias("v")).collect()}
    for i, text in rows:
        want = [0.0] * 8
        for t in (text or "").lower().replace(",", " ").split():
            want[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 8] += 1
        assert got[i] == want


def test_nearest_examples_are_ranked_where_they_are(spark, small_batches, monkeypatch):
    corpus = described(spark, 200)
    asked = spark.createDataFrame([(1, "topic3 x1"), (2, "nothing")], "query_id long, text string")
    held = spark.createDataFrame([("topic3 x0",)], "text string")
    seen = ranked_rows(monkeypatch, dense)
    found = methods.build("M2", corpus, held_out=held).pool(asked, 5)
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in found.top.collect()}
    vector = lambda t: [sum(int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 == b for w in t.split()) for b in range(64)]
    for q, text in ((1, "topic3 x1"), (2, "nothing")):
        scores = [(i, max([0.0, *(cosine(vector(text), vector(t)) for t in (f"topic{i % 7} x{j}" for j in range(i % 4)) if t != "topic3 x0")]) + (0.04 if i % 2 else 0.0)) for i in range(200)]
        assert [got[q, p] for p in range(1, 6)] == [(d, round(s, 9)) for d, s in first(scores, 5)]
        s = np.array([x for _, x in scores])
        assert abs({r.query_id: r.confidence for r in found.confidence.collect()}[q] - (s.max() - s.mean()) / s.std()) < 1e-9
    assert seen[0] <= 2 * 5 * 4


def test_leaderboard_prints_as_its_sql_does(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [k / 80 for k in range(81)] + [k / 16 for k in range(16)] + [0.0005, 0.9995, 1 / 3]
    made = metrics.leaderboard(spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "method string, mrr double"))
    want = {str(i): duckdb.sql(f"SELECT printf('%.3f', {v!r}::DOUBLE)").fetchall()[0][0] for i, v in enumerate(values)}
    assert {r.method: r.value for r in made.collect()} == want and want["9"] == "0.113"
    odd = metrics.leaderboard(spark.createDataFrame([("a", None), ("b", float("nan"))], "method string, mrr double"))
    assert {r.method: r.value for r in odd.collect()} == {"a": "n/a", "b": "nan"}
