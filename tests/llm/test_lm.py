import collections
import math
import os
import re
import zlib

import numpy as np
import pytest

from rankloom.llm import chunks as ch, lm

from .samples import documents, frame


def test_counts_and_base_agree_with_brute_force(spark):
    rows = documents(8, 50)
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 5
    c = collections.Counter(w for i, t in rows if fold(i) not in (-1, 1) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), fold(i) == 1, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6)) for i, t in rows)
    got = lm.score(frame(spark, rows), vocabulary=64, hidden=8).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score(frame(spark, []), vocabulary=64).count() == 0


def test_probabilities_sum_to_one():
    net = lm.Network(37, 8, seed=1)
    h = np.random.default_rng(0).normal(size=(3, 8)).astype(np.float32)
    total = sum(np.exp(net.log_probabilities(h, np.full(3, t))) for t in range(37))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients_agree_with_differences():
    net = lm.Network(11, 5, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    target, real = rng.integers(0, 11, (4, 3)), np.ones((4, 3), bool)
    real[3, 1] = False
    h, last = rng.normal(size=(3, 5)), np.zeros(3, np.int64)

    def loss():
        state, x, total = h, last, 0.0
        for i in range(4):
            state = net.step(net.p["x"][x] + net.p["b"], state)
            total -= net.log_probabilities(state, target[i])[real[i]].sum()
            x = target[i]
        return total / real.sum()

    grads = net._window(target, real, h, last)[0]
    for k, (part, at) in grads.items():
        g = np.zeros_like(net.p[k])
        g[at] = part
        flat = net.p[k].reshape(-1)
        for at in rng.integers(0, flat.size, 6):
            old = flat[at]
            flat[at] = old + 1e-4
            up = loss()
            flat[at] = old - 1e-4
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-4 - g.reshape(-1)[at]) < 1e-3, k


def test_training_learns_an_order_and_windows_carry_state():
    net = lm.Network(6, 12, seed=3)
    docs = [np.array([2, 3, 4, 5] * 10 + [0]) for _ in range(64)]
    before = net.score(docs[:1])[0]
    for k in range(12):
        net.train(docs, rows=16, seed=k)
    assert net.score(docs[:1])[0] > 0.5 * before
    long = [np.array([2, 3, 4, 5] * 100 + [0]), np.array([0])]
    assert np.allclose(net.score(long, window=7), net.score(long, window=500), atol=1e-2)


def test_every_training_document_trains_the_network(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = [i for i in range(80) if fold(i) != 1]
    chunks, size = ch.store(frame(spark, [(i, " ".join([f"w{i}"] * 20)) for i in range(80)]), "lm")
    counts, _, replies = lm.count(chunks, ch.bucket_count(size), 128)
    net = lm.train(lm.prepare(chunks, replies, counts), counts, hidden=8)
    assert len(counts.words) == len(ids)
    moved = np.abs(net.p["x"] - lm.Network(len(ids) + 2, 8).p["x"]).max(axis=1)  # of the input table, only rows of words learnt from move
    assert (moved[2:] > 1e-4).all()


def test_classes_cover_all_entries():
    for entries in (1, 2, 7, 4098):
        starts = lm.class_starts(entries)
        assert starts[0] == 0 and starts[-1] == entries and (np.diff(starts) > 0).all()


def test_held_out_documents_are_likelier_than_by_their_words_counts(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = lm.score(spark.read.parquet(path).select("doc_id", "text")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.99 * sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.6 * len(rows)


def test_logits_of_any_size_give_the_same_shares_and_gradients():
    """What all entries' biases have in common changes nothing, whether exponentials are shifted first or not."""
    rng = np.random.default_rng(9)
    x, place = rng.normal(0, 3, (50, 7)), rng.integers(0, 7, 50)
    logs = [lm._log_shares(x.copy(), np.full(7, by), place, False)[0] for by in (0.0, 30.0, 900.0, -900.0)]
    assert all(np.allclose(logs[0], v) for v in logs[1:])
    target, real = rng.integers(0, 40, (5, 6)), rng.random((5, 6)) < 0.8
    grads = []
    for by in (0, 900):
        net = lm.Network(40, 4)
        net.p = {k: v.astype(float) for k, v in net.p.items()}
        net.p["wb"] += by
        grads.append(net._window(target, real, np.zeros((6, 4)), np.zeros(6, np.int64))[0])
    assert all(np.allclose(grads[0][k][0], grads[1][k][0], atol=1e-9) for k in grads[0])
