"""Counts over findings. All are partial aggregations followed by one small shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leaksieve.catalogue import SEVERITIES
from leaksieve.functions.labels import sarif_level, security_severity, severity_rank, short_description

FINDING_ORDER = ("target", "file_path", "line_number", "ord")


def totals(findings: DataFrame) -> DataFrame:
    """One row: finding_count, has_findings, critical_count, high_count."""
    return findings.agg(
        F.count("*").alias("finding_count"),
        (F.count("*") > 0).alias("has_findings"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_file(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.groupBy(*(columns or ("file_path",))).agg(F.count("*").alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("ord", "rule_id").agg(F.count("*").alias("n"))


def severity_table(findings: DataFrame) -> DataFrame:
    """Counts of the severities present, most severe first; other severities are left out."""
    known = [row[0] for row in SEVERITIES]
    counted = by_severity(findings.where(F.col("severity").isin(*known)))
    rank = severity_rank(F.col("severity"))
    return counted.select("severity", rank.alias("severity_rank"), "n").orderBy(F.desc("severity_rank"))


def rule_counts(rules: DataFrame) -> DataFrame:
    """Rules per severity."""
    return rules.groupBy("severity").agg(F.count("*").alias("n"))


def rule_listing(rules: DataFrame) -> DataFrame:
    """The catalogue as a table, in order."""
    return rules.select(
        "ord", "rule_id", "rule_name", F.upper("severity").alias("severity"),
        short_description(F.col("description")).alias("description")).orderBy("ord")


def json_summary(findings: DataFrame) -> DataFrame:
    """One row: total_findings, critical, high and a severity → count map."""
    counted = by_severity(findings)
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"),
        F.coalesce(F.sum(F.when(F.col("severity") == "critical", F.col("n"))), F.lit(0)).alias("critical"),
        F.coalesce(F.sum(F.when(F.col("severity") == "high", F.col("n"))), F.lit(0)).alias("high"),
        F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("by_severity"))


def rules_used(findings: DataFrame, order: tuple[str, ...] = FINDING_ORDER) -> DataFrame:
    """Every rule id once, with its attributes, in the order of first occurrence."""
    first = findings.groupBy("rule_id").agg(
        F.min(F.struct(*order)).alias("first_seen"),
        F.min_by(F.struct("rule_name", "severity", "description"), F.struct(*order)).alias("rule"))
    severity = F.col("rule.severity")
    return first.select(
        "rule_id", F.col("rule.rule_name").alias("rule_name"), severity.alias("severity"),
        F.when(F.length("rule.description") > 0, F.col("rule.description"))
         .otherwise(F.col("rule.rule_name")).alias("full_description"),
        sarif_level(severity).alias("level"), security_severity(severity).alias("security_severity"),
        "first_seen").orderBy("first_seen")


def verdict(findings: DataFrame) -> DataFrame:
    """One row with the counts per severity and ``pass`` or ``fail``."""
    counts = [F.count_if(F.col("severity") == row[0]).alias(row[0]) for row in SEVERITIES]
    total = F.count("*")
    return findings.agg(
        (total > 0).alias("has_findings"), *counts,
        F.when(total > 0, F.lit("fail")).otherwise(F.lit("pass")).alias("verdict"))
