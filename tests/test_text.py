import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.plans import cases
from rankloom.sources import readers

CASES = [
    ("** TODO [#A] Plan trip   :travel:summer:", "Plan trip (travel, summer)"), ("* Section", None), ("** TODO", None), ("** TODO   :a:b:", ":a:b:"),
    ("** TODO Read [[https://x.org/p][the paper]]", "Read the paper"), ("** TODO See [[obsidian:Project_Ideas]]", "See Project Ideas"), ("** TODO See [[id:deadbeef01]]", "See"),
    ("** TODO Visit https://a.com/docs/my-page.html?x=1", "Visit my page"), ("** TODO Fix *very /bad/* bug", "Fix very bad bug"), ("** TODO Call <2026-05-21 Thu> mum", "Call mum"),
    ("** TODO Get started: setup", "Get setup"), ("** TODO DONE twice", "twice"), ("* NEXT Ünïcode *ñandú*", "Ünïcode ñandú"), ("body [[link]]", None),
]


def test_headings(spark):
    lines = spark.createDataFrame([("f", i, c) for i, (c, _) in enumerate(CASES)], "file string, line int, raw string")
    got = {r.line: r.text for r in readers.tasks(lines).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want is not None}


def test_outline_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.org").write_text("* Top\n** TODO one :x:\n*** WAIT two\r\nbody\n")
    (tmp_path / "b.txt").write_text("* TODO not read\n")
    assert sorted((r.title, r.tags, r.line) for r in readers.outline_tasks(spark, str(tmp_path)).collect()) == [("one", ["x"], 1), ("two", [], 2)]


@pytest.mark.parametrize(("target", "want"), [("https://a.b/c/some_page-x.html#y", "some page x"), ("id:0123456789ab", ""), ("", ""), (None, None), ("https://a.b/12", ""), ("x:///only/", "only")])
def test_readable_target(spark, target, want):
    assert spark.createDataFrame([(target,)], "t string").select(tx.readable_target(F.col("t")).alias("r")).first()["r"] == want


def test_written_out_cases(spark):
    lines = spark.createDataFrame([("f", i, c[0]) for i, c in enumerate(cases.HEADINGS)], "file string, line int, raw string")
    got = {r.line: (r.title, ",".join(r.tags), r.text) for r in readers.tasks(lines).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases.HEADINGS) if c[3] is not None}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases.TARGETS)], "i int, t string").select("i", tx.readable_target(F.col("t")).alias("w"))
    assert {r.i: r.w for r in rows.collect()} == {i: w for i, (_, w) in enumerate(cases.TARGETS)}


def test_tokens(spark):
    assert spark.createDataFrame([("Día 3, ok_x",), (None,)], "t string").select(tx.tokens(F.col("t")).alias("r")).collect()[0]["r"] == ["d", "a", "3", "ok", "x"]


def test_emphasis_is_stripped_to_any_depth(spark):
    marks = "*/" * 6  # each pass takes off the outermost pair
    deep = " ".join([*(f"{m}a" for m in marks), *(f"a{m}" for m in reversed(marks))])
    got = spark.createDataFrame([(deep,), ("*a /b/*",), (None,)], "t string").select(tx.normalized(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in got] == [" ".join("a" * 24), "a b", None]
