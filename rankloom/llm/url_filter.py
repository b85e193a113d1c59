"""URL filter: a trie over reversed host labels, then path segments, broadcast to the executors.

A rule is ``(action, host, path)``. It fits its host and every subdomain of it when the URL's path starts with the
rule's path. Of all fitting rules the longest wins: most host labels, then longest path; on a full tie block wins.

Defined cases: a null or relative URL (no ``://``) has an empty host and path and takes the default verdict, as does a
URL no rule fits. Rows are judged one by one, so repeated rows, ties and null keys simply pass through, and an empty
table gives an empty result. Output columns ``host``, ``path``, ``rule`` and ``verdict`` replace input columns of the
same names. Texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Most rules that are broadcast as a trie; larger rule tables are joined instead.
MAX_BROADCAST_RULES = 500_000

_RESULT = "struct<rule:string,verdict:string>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts: host labels from the right, then whole path segments; a rule's last, open segment is a tail.

    ``"/"`` leads from a host node to its path root; ``None`` holds the rules ending in a node as ``(tail, rule, action)``.
    """

    def __init__(self, rules: Iterable[Sequence[str]]) -> None:
        self.root: dict = {}
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            node = node.setdefault("/", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("." + segment, {})
            ends = node.setdefault(None, [])
            ends.append((tail, host + path, action))
            # longest tail first; of equal ones block before allow
            ends.sort(key=lambda e: (-len(e[0]), e[2] != "block"))

    @staticmethod
    def _deepest(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            for tail, rule, action in node.get(None, ()):
                # the tail is a prefix of all that is left of the path, which starts with this segment
                if segment.startswith(tail):
                    best = (rule, action)
                    break
            if i + 1 == len(segments) or (node := node.get("." + segment)) is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """``(rule, action)`` of the longest fitting rule."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.get("." + label)) is None:
                break
            if "/" in node:
                best = self._deepest(node["/"], segments) or best
        return best


def filter_urls(
    df: DataFrame, rules: Iterable[Sequence[str]] | DataFrame, url: str = "url", default: str = "allow",
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host + path of the winning rule, else null) and ``verdict``.

    ``rules``: rows of (action, host, path), or a DataFrame with these columns. Up to ``max_broadcast_rules`` of them
    are broadcast as a trie; beyond that bound the rules are joined on every host suffix of a URL.
    """
    spark = df.sparkSession
    df = df.drop("rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}) if url not in (
        "host", "path", "rule", "verdict") else df.withColumn("__url", F.col(url)).drop("rule", "verdict").withColumns(
        {"host": url_host(F.col("__url")), "path": url_path(F.col("__url"))}).drop("__url")
    if isinstance(rules, DataFrame):
        rules = rules.select("action", "host", "path")
        head = rules.limit(max_broadcast_rules + 1).collect()
        if len(head) > max_broadcast_rules:
            return _joined(df, rules, default)
        rules = [tuple(r) for r in head]
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf(_RESULT)
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.judge(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    judged = df.withColumn("__judged", judge("host", "path"))
    return judged.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")


def _joined(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Way beyond the broadcast bound: distinct (host, path) pairs meet the rules on each host suffix, at most one per label."""
    keys = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    asked = keys.withColumn("r_host", F.explode(suffixes))
    rules = rules.select(F.col("action").alias("r_action"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    best = F.max(F.struct(
        F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("length"), F.col("r_action"),
        F.concat("r_host", "r_path").alias("rule"),
    )).alias("best")  # "block" sorts after "allow", so block wins a full tie
    found = asked.join(rules, "r_host").where(F.col("path").startswith(F.col("r_path"))).groupBy("host", "path").agg(best)
    found = found.select(F.col("host").alias("f_host"), F.col("path").alias("f_path"), "best")
    out = df.join(found, (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path")), "left")
    return out.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.r_action", F.lit(default))}).drop("f_host", "f_path", "best")
