"""SQL views over rules and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leaksieve.rules import RuleSet


def register_views(findings: DataFrame, rules: RuleSet | None = None) -> None:
    """Makes ``rules`` and ``findings`` available to ``spark.sql``."""
    (rules or RuleSet.builtin()).to_frame(findings.sparkSession).createOrReplaceTempView("rules")
    findings.createOrReplaceTempView("findings")
