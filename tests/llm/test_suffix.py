import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rankloom.llm import suffix

from .samples import documents, frame


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80) | st.lists(st.sampled_from([97, 98]), max_size=80).map(bytes))
def test_suffix_array_and_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix.suffix_array(text, 96)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])

    def common(a, b):
        n = 0
        while n < 50 and a + n < len(data) and b + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        return n

    got = suffix.common_prefixes(text, order, 50).tolist()
    assert got == [0] * bool(got) + [common(a, b) for a, b in zip(order[1:].tolist(), order[:-1].tolist(), strict=True)]


def brute(rows, length):
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        for a in range(len(b) - length + 1):
            least[b[a : a + length]] = min(least.get(b[a : a + length], float("inf")), i)
    out = []
    for (own, _), (i, b) in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for a in range(len(b) - length + 1):
            if least[b[a : a + length]] < i:
                gone[a : a + length] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone.tolist()) if not g)
        out.append((own, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "shingle"), [(50, 20), (24, 8)])
def test_removals_agree_with_brute_force(spark, length, shingle):
    rows = documents(6, 60) + [(201, "a" * 300), (202, "b" + "a" * 200), (203, "é" * 100), (204, "xé" + "é" * 60)]
    got = suffix.digest(frame(spark, rows), length, shingle)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, length)


def test_clean_cuts_whole_characters(spark):
    got = {r.doc_id: r.text for r in suffix.clean(frame(spark, [(1, "é" * 40), (2, "x" + "é" * 40 + "y"), (3, None)])).collect()}
    assert got == {1: "é" * 40, 2: "xy", 3: None}


def test_empty(spark):
    assert suffix.digest(frame(spark, [])).count() == 0
