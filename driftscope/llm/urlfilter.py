"""URL rules by host suffix and path prefix, as DataFrame expressions only.

Each URL is expanded into all host suffixes times the path prefixes that are as
long as some rule's.  Expressions meet rules in an equi-join on the first eight
hex digits of their SHA-256; the full digest confirms a match, and of several
matching rules the longest wins (of equally long ones that with the longer host,
of equal rules the one that blocks).

Different URLs are expanded once, however often they occur.  The lengths of the
rules' paths are collected: at most as many as the longest path has characters.

A null URL, or one without ``://``, has an empty host and path and no rule.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL; both empty if it has none."""
    start = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``rule_host, rule_path, verdict`` from (verdict, host, path)."""
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("verdict"))
            for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; input columns of these names are replaced.

    ``rules`` has ``rule_host, rule_path, verdict``, the last allow or block.
    """
    rules = rules.select(F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_length"),
                         "verdict").groupBy("rule", "host_length").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("rule_digest", _digest(F.col("rule")))
    rules = rules.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    lengths = [r[0] for r in rules.select((F.length("rule") - F.col("host_length")).alias("n")).distinct().collect()]

    host, path = split_url(F.col(url_column))
    split = pages.withColumns({"__host": F.coalesce(host, F.lit("")), "__path": F.coalesce(path, F.lit(""))})
    different = split.where("__host <> ''").select("__host", "__path").distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.lit(sorted(lengths)) if lengths else F.array().cast("array<int>"),
                       lambda n: n <= F.length("__path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("__path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = different.select("__host", "__path", F.explode(expressions).alias("expression"))
    expanded = expanded.select("__host", "__path", _digest(F.col("expression")).alias("digest"))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    matched = expanded.join(rules, (expanded["prefix"] == rules["prefix"]) & (F.col("digest") == F.col("rule_digest")))
    best = matched.groupBy("__host", "__path").agg(F.max(F.struct(
        F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("best"))
    best = best.select(F.col("__host").alias("__h"), F.col("__path").alias("__p"),
                       F.col("best.rule").alias("__rule"), F.col("best.verdict").alias("__verdict"))
    judged = split.join(best, (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
    return judged.withColumns({
        "host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule"),
        "verdict": F.coalesce("__verdict", F.lit(default)),
    }).drop("__host", "__path", "__h", "__p", "__rule", "__verdict")
