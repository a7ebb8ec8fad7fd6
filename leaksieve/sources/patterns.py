"""User pattern files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from leaksieve.functions.text import split_lines, strip
from leaksieve.rules import RuleSet


def pattern_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """(line, regex) of every line that is neither blank nor a ``#`` comment; lines count from 1."""
    lines = texts.select(F.posexplode(split_lines(F.col(text))).alias("pos", "raw"))
    rows = lines.select((F.col("pos") + 1).alias("line"), strip(F.col("raw")).alias("regex"))
    return rows.where((F.col("regex") != "") & ~F.col("regex").startswith("#"))


def load_patterns(spark: SparkSession, path: str | None) -> list[tuple[str, str]]:
    """Named patterns of the file; a missing file gives none.

    Every pattern becomes part of the query plan, so the list lives on the driver.
    """
    if not path:
        return []
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = pattern_rows(texts).orderBy("line").collect()
    return [(f"Custom Pattern #{row.line}", row.regex) for row in rows]


def rules_with_file(spark: SparkSession, path: str | None, rules: RuleSet | None = None) -> RuleSet:
    return (rules or RuleSet.builtin()).with_custom(load_patterns(spark, path), spark)
