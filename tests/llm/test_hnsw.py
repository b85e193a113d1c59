import numpy as np

from rankloom.llm import hnsw


def run(spark, rows, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v int")
    valid = hnsw.valid(df, "vec_id", "embedding")
    return hnsw.search(valid, valid.where("vec_id % 10 = 0"), k, **kw).collect()


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    rows += [(2000 + i, x[3].tolist(), 1, 2) for i in range(300)]  # one very common vector
    got = run(spark, rows, shard_nodes=400)
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    hit = total = 0
    for q in ids[ids % 10 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -2
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        hit, total = hit + len({r.vec_id for r in mine} & set(ids[best].tolist())), total + 5
        for r in mine:
            assert abs(r.score - s[ids == r.vec_id][0]) < 1e-9
    assert hit / total >= 0.9
    assert [r.vec_id for r in got if r.query_id == 2000 and r["rank"] <= 5] and {r.vec_id for r in got if r.query_id == 2000} == {3, 2001, 2002, 2003, 2004}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, 1), (10, [2.0, 0.0], 1, 1), (2, [0.0, 1.0], 1, 1), (3, [0.0, 0.0], 1, 1), (4, None, 1, 1), (5, [nan, 1.0], 1, 1), (6, [inf, 1.0], 1, 1),
            (7, [None, 1.0], 1, 1), (None, [1.0, 1.0], 1, 1), (8, [], 1, 1), (9, [1.0, 2.0, 3.0], 1, 1), (0, [1.0, 0.0], 1, 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in run(spark, rows))
    assert got == [(0, 1, 10, 1.0), (0, 2, 2, 0.0), (10, 1, 0, 1.0), (10, 2, 2, 0.0)]
    assert run(spark, []) == []


def test_ties_of_scaled_copies_go_to_smaller_ids(spark):
    rows = [(i, [3.0 * 2.0**i, 2.0**i], 1, 1) for i in range(40)]
    got = run(spark, rows)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [1, 2, 3, 4, 5]
