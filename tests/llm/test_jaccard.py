import re

import numpy as np
import pytest

from rankloom.llm import jaccard

from .samples import documents, frame


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "n", "percent"), [(0, 4, 85), (1, 2, 80)])
def test_components_agree_with_brute_force(spark, seed, n, percent):
    rows = documents(seed, 80)
    base = [f"b{i}" for i in range(60)]
    rng = np.random.default_rng(seed)
    for k in range(40):  # near copies at all distances round the threshold
        w = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 5)):
            w[p] = f"c{rng.integers(0, 9)}"
        rows.append((500 + k, " ".join(w[: 60 - int(rng.integers(0, 8))])))
    got = sorted((tuple(r) for r in jaccard.digest(frame(spark, rows), n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_keep_one(spark):
    rows = documents(2, 40)[:40]  # ids are unique here
    want = brute(rows, 4, 85)
    kept = jaccard.keep_one(frame(spark, rows)).collect()
    assert kept[0].asDict().keys() == frame(spark, rows).first().asDict().keys()
    # one row of each component, and every row without words
    components = {c for _, n, c in want if n}
    assert len([r for r in kept if (r.text or "").split()]) == len(components)
    assert {r.doc_id for r in kept if (r.text or "").split()} == components


def test_signatures_of_linking_sets_meet():
    rng = np.random.default_rng(3)
    for size in (5, 7, 12, 40, 150, 700):
        for _ in range(30):
            a = np.unique(rng.integers(1, 1 << 60, size, dtype=np.uint64))
            keep = rng.random(len(a)) > rng.random() * 0.2
            b = np.unique(np.concatenate([a[keep], rng.integers(1, 1 << 60, rng.integers(0, max(1, size // 8)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < 85 * (len(a) + len(b) - common) or common == len(a) == len(b):
                continue
            off = np.array([0, len(a), len(a) + len(b)])
            sig, row = jaccard.signatures(np.concatenate([a, b]), off, np.array([0, 1]), 85)
            assert len(np.intersect1d(sig[row == 0], sig[row == 1])), (len(a), len(b), common)


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(1, 1 << 63, rng.integers(1, 400), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(1, 1 << 63, rng.integers(0, 200), dtype=np.uint64)]))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_empty(spark):
    assert jaccard.digest(frame(spark, [])).count() == 0


def test_shared_counts_are_exact():
    rng = np.random.default_rng(7)
    pool = np.unique(rng.integers(1, 1 << 63, 6000, dtype=np.uint64))
    x, y = ([np.sort(rng.choice(pool, rng.integers(1, 3000), replace=False)) for _ in range(n)] for n in (5, 7))
    assert (jaccard.shared(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()
    assert (jaccard.shared(x[:1], [np.array([3], np.uint64)]) == 0).all()


def test_large_groups_near_the_threshold(spark, monkeypatch):
    """Blocks of four nodes: pairs across blocks, and signatures of more nodes than a block, lose no link."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(120):
        w = list(base)
        for p in rng.choice(80, int(rng.integers(1, 4)), replace=False):
            w[p] = f"c{rng.integers(0, 40)}"
        rows.append((k, " ".join(w)))
    got = sorted((tuple(r) for r in jaccard.digest(frame(spark, rows), 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85) and 1 < len({c for *_, c in got}) < 120


def test_blocks_of_a_template_are_compared_only_where_sets_can_link(spark, monkeypatch):
    """Sets with a template in common and no n-grams alone, none of which link: what is shuffled must not grow with their square."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    made, blocks_of = [], jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda *a: made.append(blocks_of(*a)) or made[-1])
    remove = jaccard.remove
    counted = []
    monkeypatch.setattr(jaccard, "remove", lambda *a: counted.append(made[-1][1].count()) if made and not counted else remove(*a))
    part = lambda p, n: [f"{p}x{i}" for i in range(n)]
    rows = [(k, " ".join(part("t", 60) + part(f"a{k // 2}", 10) + part(f"b{k // 4}{(k + 1) % 4 // 2}", 10))) for k in range(120)]
    got = sorted((tuple(r) for r in jaccard.digest(frame(spark, rows), 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85) and len({c for *_, c in got}) == 120
    assert counted[0] <= 40  # with every two of 30 blocks: 465


def test_comparison_in_rounds(spark, monkeypatch):
    """Several rounds of pairs of blocks find what one does."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 1)
    monkeypatch.setattr(jaccard.ch, "store", lambda *a, f=jaccard.ch.store: (f(*a)[0], 40_000))
    rounds, compared = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda percent: rounds.append(percent) or compared(percent))
    rng = np.random.default_rng(11)
    rows = []
    for k in range(120):
        w = [f"b{i}" for i in range(80)]
        for p in rng.choice(80, int(rng.integers(1, 5)), replace=False):
            w[p] = f"c{rng.integers(0, 40)}"
        rows.append((k, " ".join(w)))
    got = sorted((tuple(r) for r in jaccard.digest(frame(spark, rows), 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85) and len(rounds) > 1


def test_the_driver_collects_after_each_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "written", lambda df, name, f=jaccard.written: seen.append("table") or f(df, name))
    monkeypatch.setattr(jaccard, "remove", lambda *a, f=jaccard.remove: seen.append("collected") or f(*a))
    jaccard.digest(frame(spark, documents(4, 30))).count()
    assert "table" in seen and all(b == "collected" for a, b in zip(seen, seen[1:], strict=False) if a == "table")
