"""Scanning with thousands of rules: an inverted index of their keywords instead of one expression per rule.

The index is a table with a row per keyword, found by one *gram* of the keyword: a substring of one, two, four or eight
characters, of those the one that fewest keywords share. The distinct grams of every line are joined to it,
the keyword is looked for in the line, and what is left are the few rules whose pattern has to be searched in that
line. The plan has one size whatever the number of rules; patterns, names and severities are data.

Where the index is too large to be broadcast, a filter of bounded size with its grams is, and lines are moved for those of their grams
that the filter holds: these are the index's own, and a few others that the join drops.

Rules without keywords are looked for in every line, as they would be by expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leaksieve.functions.regex import to_java
from leaksieve.functions.text import long_enough, split_lines, strip
from leaksieve.plans.filters import may_hold
from leaksieve.plans.partitioning import dealt
from leaksieve.plans.scratch import scratch_dir
from leaksieve.rules import SEVERITY_RANK, RuleSet

GRAM_LENGTHS = (8, 4, 2, 1)
#: An index of up to this many bytes is broadcast; larger ones are joined as Spark sees fit.
BROADCAST_BYTES = 64 << 20

_RULE = ("ord", "rule_id", "rule_name", "severity", "severity_rank", "description")


def _grams(text, length: int):
    """All substrings of one length, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def rule_rows(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The rules as rows for ``rule_index``."""
    attributes = rules.to_frame(spark).select(*_RULE, F.transform("keywords", F.lower).alias("keywords"))
    patterns = [(i, r.java_pattern, r.matches_empty) for i, r in rules.numbered()]
    return attributes.join(spark.createDataFrame(patterns, "ord int, java_pattern string, matches_empty boolean"), "ord")


def python_rule_rows(rules: DataFrame) -> DataFrame:
    """Rows for ``rule_index`` from a table of rules: ord, rule_id, pattern (a Python regular expression), and, as far as there
    are any, rule_name, severity, description and keywords."""
    rewritten = F.udf(to_java, "string")("pattern")
    defaults = {"rule_name": F.col("rule_id"), "severity": F.lit("medium"), "description": F.lit(""), "keywords": F.array().cast("array<string>")}
    rules = rules.withColumns({c: value for c, value in defaults.items() if c not in rules.columns})
    ranks = F.create_map(*[F.lit(v) for pair in SEVERITY_RANK.items() for v in pair])
    return rules.select(
        F.col("ord").cast("int").alias("ord"), "rule_id", "rule_name", "severity",
        F.coalesce(ranks[F.col("severity")], F.lit(0)).cast("int").alias("severity_rank"), "description",
        F.transform("keywords", F.lower).alias("keywords"), rewritten.alias("java_pattern"), F.lit(True).alias("matches_empty"))


class RuleIndex:
    """The table of keywords and grams, written once, and what the scan needs to know about it."""

    def __init__(self, rules: DataFrame):
        spark = rules.sparkSession
        rules = rules.withColumn("keywords", F.array_distinct("keywords"))
        words = rules.select("ord", F.posexplode("keywords").alias("place", "keyword"))
        each = words.select("ord", "place", "keyword", F.explode(self._choices()).alias("gram"))
        shared = each.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
        best = shared.groupBy("ord", "place").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
        gated = rules.join(best, "ord").select(
            *rules.columns, "gram", F.col("keywords")[F.col("place")].alias("keyword"), F.slice("keywords", F.lit(1), F.col("place")).alias("earlier"))
        ungated = rules.where(F.size("keywords") == 0).select(
            "*", F.lit("").alias("gram"), F.lit("").alias("keyword"), F.array().cast("array<string>").alias("earlier"))
        folder = f"{scratch_dir(spark)}/index"
        gated.unionByName(ungated).write.parquet(folder)
        self.table = spark.read.parquet(folder)
        width = sum((F.octet_length(c) for c in ("rule_id", "rule_name", "description", "java_pattern", "gram", "keyword")), F.lit(100))
        width = width + F.octet_length(F.concat_ws(" ", "keywords"))
        sizes = self.table.groupBy(F.length("gram").alias("length")).agg(F.sum(width).alias("bytes")).collect()
        self.lengths: Sequence[int] = sorted(r.length for r in sizes)
        self.bytes = sum(r.bytes for r in sizes)

    @staticmethod
    def _choices():
        """The substrings of a keyword that may stand for it: of the greatest length it has."""
        length = F.length("keyword")
        chosen = F.array(F.lit(""))
        for n in reversed(GRAM_LENGTHS):
            chosen = F.when(length >= n, F.array_distinct(_grams(F.col("keyword"), n))).otherwise(chosen)
        return chosen


def scan_with_index(df: DataFrame, text: str, index: RuleIndex, *, partitions: int | None = None) -> DataFrame:
    """What ``scan_text`` gives, from an index of the rules. No text is shuffled where the index is broadcast."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows = dealt(df, partitions).select(*keep, F.posexplode(split_lines(F.col(f"`{text}`"))).alias("__pos", "__line"))
    rows = rows.where(long_enough(F.col("__line"))).select("*", F.lower("__line").alias("__low"))
    grams = [F.array(F.lit("")) if n == 0 else _grams(F.col("__low"), n) for n in index.lengths] or [F.array().cast("array<string>")]
    rows = rows.select("*", F.explode(F.array_distinct(F.concat(*grams))).alias("__gram"))
    table = index.table.select(*[F.col(c).alias(f"__{c}") for c in index.table.columns if c not in _RULE], *_RULE).withColumnRenamed("__gram", "__key")
    if index.bytes <= BROADCAST_BYTES:
        table = F.broadcast(table)
    else:
        rows = rows.where(may_hold(index.table.select(F.col("gram").alias("__gram")), "__gram")).drop("__low")
    found = rows.join(table, F.col("__gram") == F.col("__key")).withColumn("__low", F.lower("__line")).where(
        # A line with several keywords of a rule is taken by the first of them.
        F.contains("__low", F.col("__keyword")) & ~F.exists("__earlier", lambda k: F.contains(F.col("__low"), k)))
    found = found.where(F.expr("regexp_instr(__line, __java_pattern) > 0"))
    found = found.select(*keep, (F.col("__pos") + 1).alias("line_number"), *_RULE[:5], strip(F.col("__line")).alias("snippet"),
                         F.expr("regexp_extract(__line, __java_pattern, 0)").alias("matched_text"), "description", "__matches_empty")
    return found.where("__matches_empty OR matched_text <> ''").drop("__matches_empty")
