"""Text clean-up on cases whose results are written out, and on text built so that SQL knows the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions import text as tx

#: (line, title, tags joined by a comma, text); None: no task
HEADINGS = (
    ("** TODO [#A] Plan trip   :travel:summer:", "Plan trip", "travel,summer", "Plan trip (travel, summer)"),
    ("* Section", None, None, None),
    ("TODO no stars", None, None, None),
    ("** TODO", None, None, None),
    ("** TODO   :a:b:", ":a:b:", "", ":a:b:"),
    ("** LATER not a keyword", None, None, None),
    ("** TODO Read [[https://x.org/p][the paper]]", "Read the paper", "", "Read the paper"),
    ("** TODO See [[obsidian:Project_Ideas]]", "See Project Ideas", "", "See Project Ideas"),
    ("** TODO See [[ obsidian:Foo_Bar ]]", "See Foo Bar", "", "See Foo Bar"),
    ("** TODO See [[id:deadbeef01]]", "See", "", "See"),
    ("** TODO Visit https://a.com/docs/my-page.html?x=1", "Visit my page", "", "Visit my page"),
    ("** TODO Visit https://a.com/docs/ and https://a.com/docs/my-page", "Visit docs and my page", "", "Visit docs and my page"),
    ("** TODO Mail mailto:jane_doe@x.org now", "Mail jane doe@x now", "", "Mail jane doe@x now"),
    ("** TODO Open [[file:notes/2024-plan.org]] and [[12]]", "Open 2024 plan and", "", "Open 2024 plan and"),
    ("** TODO Link in link [[mailto:ann-lee@y.net]]", "Link in link ann lee@y", "", "Link in link ann lee@y"),
    ("** TODO Fix *very /bad/* bug", "Fix very bad bug", "", "Fix very bad bug"),
    ("** TODO Keep a*b and snake_case_name", "Keep a*b and snake_case_name", "", "Keep a*b and snake_case_name"),
    ("** TODO Call <2026-05-21 Thu> mum [2026-05-22]", "Call mum", "", "Call mum"),
    ("** TODO Get started: setup", "Get setup", "", "Get setup"),
    ("** TODO DONE twice", "twice", "", "twice"),
    ("** WAIT deadline: x :t:", "x", "t", "x (t)"),
    ("* NEXT :only:tags:", ":only:tags:", "", ":only:tags:"),
    ("* DONE x  :@home:#1:50%:", "x", "@home,#1,50%", "x (@home, #1, 50%)"),
    ("*** MAYB =code= and ~verb~ +old+ _under_", "code and verb old under", "", "code and verb old under"),
    ("*  INPR   Ünïcode *ñandú*  here ", "Ünïcode ñandú here", "", "Ünïcode ñandú here"),
    ("", None, None, None),
)
#: (target, words)
TARGETS = (
    ("https://a.b/c/some_page-x.html#y", "some page x"), ("https://a.b/c/d/?q=1", ""), ("https://a.b/c/?q=word/two_three", "two three"), ("id:0123456789ab", ""), ("", ""), ("https://a.b/12", ""),
    ("x:///only/", "only"), ("///", ""), ("file:", ""), ("  obsidian:Foo_Bar  ", "Foo Bar"), ("plain", "plain"), ("a/b/c.tar.gz", "c.tar"), ("name.toolongext", "name.toolongext"), ("#frag", ""),
    ("deadbeef", ""), ("deadbeefs", "deadbeefs"), ("dead-beef-01", "dead beef 01"), ("https://host.org", "host"), ("страница", ""), ("x.y/Ёлка-ab", "Ёлка ab"), ("--a_b--", ""), ("--ab_b--", "ab b"),
)


def _quoted(values: tuple) -> str:
    return "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + ")"


def heading_cases(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.createDataFrame([(i, c[0]) for i, c in enumerate(HEADINGS)], "case_id int, line string")
    h = tx.heading(F.col("line"))
    return lines.select("case_id", h["title"].alias("title"), F.array_join(h["tags"], ",").alias("tags"), h["text"].alias("text"))


HEADING_CASES = "SELECT * FROM (VALUES " + ", ".join(_quoted((i, *c[1:])) for i, c in enumerate(HEADINGS)) + ") AS t(case_id, title, tags, text)"


def readable_target_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TARGETS)], "case_id int, target string")
    return rows.select("case_id", tx.readable_target(F.col("target")).alias("words"))


READABLE_TARGET_CASES = "SELECT * FROM (VALUES " + ", ".join(_quoted((i, w)) for i, (_, w) in enumerate(TARGETS)) + ") AS t(case_id, words)"


def url_readable_target(spark: SparkSession, sf: str) -> DataFrame:
    """Of each page's URL, its last two segments as a file's name."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    named = F.regexp_replace("url", r"/([a-z]+)/([0-9]+)(\.html)?", "/files/$1-page_$2.html")
    return pages.select("page_id", tx.readable_target(named).alias("target"))


URL_READABLE_TARGET = r"""SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN regexp_matches(url, '/[a-z]+/[0-9]+')
  THEN regexp_extract(url, '/([a-z]+)/[0-9]+', 1) || ' page ' || regexp_extract(url, '/[a-z]+/([0-9]+)', 1) ELSE '' END AS target FROM pages"""


def heading_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Headings made of the first words of each turn, with everything that clean-up takes off, parsed again."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    w = F.slice(tx.tokens(F.col("text")), 1, 5)
    line = F.concat(
        F.lit("** TODO [#B] "), w[0], F.lit(" SCHEDULED: <2026-01-02 Fri> *"), w[1], F.lit("* [[x:y/aa_"), w[2], F.lit("-"), w[3], F.lit(".html#z]] [[t]["), w[4], F.lit("]]  :t"), F.col("turn").cast("string"), F.lit(":"))
    h = tx.heading(line)
    return turns.where(F.size(w) == 5).select("conv_id", "turn", h["title"].alias("title"), F.array_join(h["tags"], ",").alias("tags"), h["text"].alias("text"))


HEADING_PARSE = """WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:5] AS w FROM conversations),
t AS (SELECT conv_id, turn, w[1] || ' ' || w[2] || ' aa ' || w[3] || ' ' || w[4] || ' ' || w[5] AS title, 't' || turn AS tags FROM w WHERE len(w) = 5)
SELECT conv_id, turn, title, tags, title || ' (' || tags || ')' AS text FROM t"""


def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each turn in nested emphasis, cleaned up."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    w = F.slice(tx.tokens(F.col("text")), 1, 3)
    marked = F.concat(F.lit("*/_=~+"), w[0], F.lit("+~=_/*  mailto:"), w[1], F.lit("zz@x.org\t/"), w[2], F.lit("/"))
    return turns.where(F.size(w) == 3).select("conv_id", "turn", tx.normalized(marked).alias("title"))


NORMALIZED_TEXT = """WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:3] AS w FROM conversations)
SELECT conv_id, turn, w[1] || ' ' || w[2] || 'zz@x ' || w[3] AS title FROM w WHERE len(w) = 3"""


QUERIES = {f.__name__: f for f in (heading_cases, readable_target_cases, url_readable_target, heading_parse, normalized_text)}
ORACLE = {"heading_cases": HEADING_CASES, "readable_target_cases": READABLE_TARGET_CASES, "url_readable_target": URL_READABLE_TARGET, "heading_parse": HEADING_PARSE, "normalized_text": NORMALIZED_TEXT}
