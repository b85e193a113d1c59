import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rankloom.llm import packing

from .samples import documents, frame

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*FILES)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(st.sampled_from("ab1 \n\t'sé.  ſ日"), max_size=40))
def test_ids_are_those_of_the_tokenizer(encoder, text):
    assert encoder.ids(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_token_strings(encoder):
    assert np.frombuffer(encoder.ids("a <|endoftext|> b"), "<u4").tolist().count(50256) == 1


def test_bounds_never_exceed_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 11, 7)
        best = next(k for k in itertools.count(1) if fits(sorted(sizes.tolist(), reverse=True), [10] * k))
        bins, offsets, n = packing.best_fit(sizes, 10)
        assert packing.lower_bound(sizes, 10) <= best <= n
        assert np.bincount(bins, weights=sizes).max() <= 10


def fits(sizes, room):
    if not sizes:
        return True
    return any(room[i] >= sizes[0] and fits(sizes[1:], [*room[:i], room[i] - sizes[0], *room[i + 1 :]]) for i in range(len(room)))


def check(rows, got, capacity):
    tok = Tokenizer.from_file(FILES[0])
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want.append((str(i), k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packs_everything_once(spark, capacity):
    rows = documents(9, 60)
    check(rows, packing.best_fit_pack(frame(spark, rows), *FILES, capacity).collect(), capacity)
    assert packing.best_fit_pack(frame(spark, []), *FILES).count() == 0


def test_exchange_saves_sequences(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(300, 700, 400)
    rows = [(i, 0, 0, int(n), 1) for i, n in enumerate(sizes)]
    found = spark.createDataFrame(rows, packing.PIECES)
    count = lambda rounds: packing.pack(found, rounds=rounds, group_pieces=20).select("sequence_id").distinct().count()
    assert count(3) <= count(0)
    assert packing.pack(found, group_pieces=20).count() == 400
