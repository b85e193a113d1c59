import hashlib
import re

import pytest

from rankloom.llm import decontam

from .samples import documents, frame


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[key]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "w1 w2"), (2, "The"), (3, None), (4, ""), (None, "one"), (10, "two words"), (10, "two words"), (9, "! ?")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_hits_agree_with_brute_force(spark, block):
    rows = documents(3, 60)
    items = ITEMS + [(20, rows[1][1]), (21, (rows[7][1] or "").upper()), (22, " ".join((rows[13][1] or "").split()[5:22]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.decontaminate(frame(spark, rows), table, block_bytes=block))
    want = brute(rows, items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = decontam.clean(frame(spark, rows), table, block_bytes=block)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(not w[5] for w in want)


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.digest(decontam.decontaminate(frame(spark, [(1, "a b")]), none)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert decontam.decontaminate(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
