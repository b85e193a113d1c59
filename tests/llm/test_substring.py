import hashlib
import re

import pytest

from rankloom.llm import chunks as ch, substring

from .samples import documents, frame


def brute(rows, window):
    """rows in any order; rows with one id don't count as earlier for each other."""
    texts = [(float("inf") if i is None else i, k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (i, t) in enumerate(rows)]
    least, first = {}, {}
    for i, k, w in texts:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            least[key] = min(least.get(key, float("inf")), i)
            first.setdefault((key, k), a)
    out = []
    for i, k, w in texts:
        gone = set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if least[key] < i or first[key, k] < a:
                gone.update(range(a, a + window))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((rows[k][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "window"), [(1, 20), (2, 20), (5, 12)])
def test_removals_agree_with_brute_force(spark, batches, window):
    rows = documents(5, 70)
    got = substring.digest(frame(spark, rows), batches, window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, window)


def test_index_compacts_and_history_counts_as_earlier(spark):
    index = substring.Index(spark, fanout=2)
    text = " ".join(f"v{i}" for i in range(40))
    lost = []
    for k, i in enumerate((9, 5, 1, 3)):  # later batches have smaller ids, but come later
        found = index.add(frame(spark, [(i, text if k != 2 else "other words")]))
        chunk = found.select("replies").first()
        lost.append(bool(chunk["replies"]))
    assert lost == [False, True, False, True]
    assert sorted(level for level, _ in index.runs) == [2]


def test_batches_beyond_1024_meet_history(spark):
    index = substring.Index(spark)
    index.stores, index.parts = [ch.store(frame(spark, []), "substring")[0]] * 1023, [0] * 1023
    text = " ".join(f"v{i}" for i in range(40))
    lost = [bool(index.add(frame(spark, [(i, text)])).select("replies").first()["replies"]) for i in (1, 2)]
    assert lost == [False, True]


def test_clean_keeps_columns_and_untouched_texts(spark):
    rows = [(1, "a  b\n" + " ".join(f"x{i}" for i in range(25))), (2, "head " + " ".join(f"x{i}" for i in range(25)) + "  tail"), (3, None), (4, "")]
    got = {r.doc_id: r for r in substring.clean(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "head tail" and got[3].text is None and got[4].text == "" and got[2].node == "y"


def test_empty(spark):
    assert substring.digest(frame(spark, [])).count() == 0
