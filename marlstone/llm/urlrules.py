"""URL filtering by rules over host suffixes and path prefixes.

Each distinct URL is expanded into the expressions that a rule could name: its host's suffixes by whole
labels and its path's prefixes, at the numbers of labels and path lengths that occur among the rules.
Expressions meet rules in an equi-join on the first 4 bytes of their SHA-256; the whole digest then
confirms, and of the rules that fit the longest wins (then the one with the longer host, then block).

Defined results: a null URL or one without ``://`` has empty host and path and no rule; without a rule the
verdict is ``default``; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 8  # hex digits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table: host, path, verdict."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of its url; columns of these names are replaced."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages(url)`` with host, path, rule and verdict, which replace columns of these names. Rules are
    keyed by (host, path)."""
    shape = rules.select(
        F.collect_set(F.size(F.split("host", "[.]"))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    pages = parsed(pages.drop("rule", "verdict"))
    urls = pages.select("host", "path").where("host <> ''").distinct()
    labels = urls.withColumn("_labels", F.split("host", "[.]")).withColumn(
        "h",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter(F.array(*[F.lit(x) for x in sorted(shape["labels"])]).cast("array<int>"), lambda k: k <= F.size("_labels")),
                    lambda k: F.array_join(F.slice("_labels", F.size("_labels") - k + 1, k), "."),
                )
            )
        ),
    )
    both = labels.withColumn(
        "p",
        F.explode(
            F.transform(
                F.filter(F.array(*[F.lit(x) for x in sorted(shape["lengths"])]).cast("array<int>"), lambda k: k <= F.length("path")),
                lambda k: F.col("path").substr(F.lit(1), k),
            )
        ),
    )
    both = both.select("host", "path", _digest(F.col("h"), F.col("p")).alias("digest"))
    both = both.withColumn("short", F.substring("digest", 1, PREFIX))
    held = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"),
            F.length("host").alias("hosts"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("found"),
    ).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    best = (
        both.join(held, "short")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max("found").alias("found"))
        .select(F.col("host").alias("_h"), F.col("path").alias("_p"), "found")
    )
    return pages.join(best, (pages.host == best["_h"]) & (pages.path == best["_p"]), "left").select(
        *pages.columns, F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )
