import json

import pytest

from rankloom.methods import Lexical
from rankloom.sources import readers
from rankloom.streaming.matching import match_stream

GOOD = {"icon_usefulness": 7, "discard": False, "visual_concepts": ["a", " "], "task_intents": [], "example_tasks": ["x", "y"], "poor_matches": None, "reasoning": "why"}


def test_descriptions(spark, tmp_path):
    files = {"good": GOOD, "gone": GOOD | {"discard": True}, "bare": {"visual_concepts": "single"}}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    for tolerant in (False, True):
        got = {r.name: r for r in readers.descriptions(spark, str(tmp_path), tolerant=tolerant).collect()}
        assert got.keys() == {"good", "bare"} and got["good"].prior == 0.7 and got["good"].visual_concepts == ["a"] and got["good"].poor_matches == [] and got["bare"].reasoning == ""
        assert got["bare"].visual_concepts == (["single"] if tolerant else [])
    bad = {r.name: set(r.problems) for r in readers.invalid_descriptions(spark, str(tmp_path)).collect()}
    assert "bare" in bad and "visual_concepts" in bad["bare"]
    text = readers.descriptions(spark, str(tmp_path)).where("name = 'good'").select(readers.document().alias("t"), readers.document(False).alias("u")).first()
    assert (text.t, text.u) == ("a. x, y. why", "a. why")


def test_catalog_codepoints_and_lists(spark, tmp_path):
    (tmp_path / "c.txt").write_text("home e88a\nbad\nx zz\n  trim   41 \n")
    assert {(r.name, r.codepoint) for r in readers.codepoints(spark, str(tmp_path / "c.txt")).collect()} == {("home", 0xE88A), ("trim", 0x41)}
    assert {r.char for r in readers.codepoints(spark, str(tmp_path / "c.txt")).collect()} == {chr(0xE88A), "A"}
    (tmp_path / "m.json").write_text(")]}'\n" + json.dumps({"icons": [{"name": "home", "tags": ["x"], "popularity": 3}, {"name": "home", "tags": ["y"], "popularity": 4}, {"name": "no", "tags": []}]}))
    built = readers.build_catalog(readers.codepoints(spark, str(tmp_path / "c.txt")), readers.metadata(spark, str(tmp_path / "m.json")))
    assert {(r.name, r.codepoint, r.char, tuple(r.tags), r.popularity) for r in built.collect()} == {("home", "e88a", chr(0xE88A), ("y",), 4), ("trim", "0041", "A", (), 0)}
    assert tuple(readers.untagged(built).first()) == (2, 1)
    readers.write_catalog(built, str(tmp_path / "catalog"))
    assert [r.name for r in spark.read.json(str(tmp_path / "catalog")).collect()] == ["home", "trim"]
    docs = spark.createDataFrame([("a",), ("b",)], "name string")
    cat = spark.createDataFrame([("a", "1", 5), ("a", "2", 6)], "name string, char string, popularity int").coalesce(1)
    assert {tuple(r) for r in readers.with_catalog(docs, cat).collect()} == {("a", "2", 6), ("b", "", 0)}
    assert {tuple(r) for r in readers.with_catalog(docs, None).collect()} == {("a", "", 0), ("b", "", 0)}
    assert [tuple(r) for r in readers.json_list(spark, '["x", "y"]').collect()] == [(0, "x"), (1, "y")]
    with pytest.raises(ValueError):
        readers.json_list(spark, '{"x": 1}')
    assert readers.missing_outputs(docs, docs.where("name = 'a'")).first()["name"] == "b"


def test_sinks(spark, tmp_path):
    made = spark.createDataFrame([(1, "a", 7, True), (2, "a", 8, True), (3, "b", 9, False)], "query_id long, text string, doc_id long, shown boolean")
    readers.write_decisions(made, str(tmp_path / "d"))
    assert {(r.text, r.doc_id) for r in spark.read.schema("text string, doc_id long").json(str(tmp_path / "d")).collect()} == {("a", 8), ("b", None)}
    readers.write_results(spark.createDataFrame([("B1", 0.5)], "method string, mrr double"), str(tmp_path / "r"), seed="0")
    row = spark.read.json(str(tmp_path / "r")).first()
    assert row.mrr == 0.5 and row.config_seed == "0" and row.written_at
    tasks = readers.tasks(spark.createDataFrame([("f", 0, "* TODO x :t:")], "file string, line int, raw string"))
    readers.write_tasks(tasks, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first().asDict() == {"file": "f", "title": "x", "tags": ["t"], "text": "x (t)"}
    (tmp_path / "ok.png").write_bytes(b"png")
    (tmp_path / "no way.png").write_bytes(b"png")
    assert [r.name for r in readers.images(spark, str(tmp_path)).collect()] == ["ok"]


def test_validation_and_fractions(spark, tmp_path):
    for name, change in {"half": {"icon_usefulness": 7.5}, "boolean": {"icon_usefulness": True}, "reason": {"reasoning": 3}, "lists": {"poor_matches": "x"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(GOOD | {"poor_matches": []} | change))
    bad = {r.name: r.problems for r in readers.invalid_descriptions(spark, str(tmp_path)).collect()}
    assert bad == {"half": ["icon_usefulness"], "lists": ["poor_matches"]}
    assert {r.name: r.prior for r in readers.descriptions(spark, str(tmp_path)).collect()}["half"] == 0.75


def test_stream(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"word{i} thing") for i in range(30)], "doc_id long, text string")
    spark.createDataFrame([(1, "word3"), (2, "none")], "query_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, text string").parquet(str(tmp_path / "in"))
    q = match_stream(Lexical(corpus, True), stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.query_id: (r.doc_id, r.shown) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (3, True), 2: (0, False)}
