"""Rules as data: an ordered, immutable set that the matcher turns into Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from leaksieve import catalogue
from leaksieve.functions.regex import is_context_free, to_java

SEVERITY_RANK = {name: rank for name, rank, _, _ in catalogue.SEVERITIES}


@dataclass(frozen=True)
class Rule:
    """One detection rule. ``pattern`` is a Python regular expression.

    ``known`` marks the rules of the catalogue, whose patterns have been checked for the matcher's
    shortcuts; only ``RuleSet.builtin`` sets it. All other rules are evaluated as they stand, whatever their category.
    """

    rule_id: str
    name: str
    pattern: str
    severity: str
    description: str = ""
    keywords: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    category: str = "custom"
    known: bool = False

    @property
    def ignores_case(self) -> bool:
        return self.pattern.startswith("(?i)")

    @property
    def java_pattern(self) -> str:
        linear = catalogue.LINEAR_FORMS.get(self.rule_id) if self.is_builtin else None
        return to_java(linear or self.pattern)

    @property
    def probes(self) -> list[str]:
        return [to_java(p) for p in catalogue.PROBES.get(self.rule_id, ())] if self.is_builtin else []

    @property
    def is_builtin(self) -> bool:
        return self.known

    @property
    def keywords_implied(self) -> bool:
        """Whether every match holds one of the keywords, as it does for case-sensitive built-in rules."""
        if self.is_builtin and not self.ignores_case:
            return True
        return any(k in need.lower() for need in self.needs for k in self.keywords)

    @property
    def matches_empty(self) -> bool:
        """Whether the pattern may match without consuming a character."""
        return not self.is_builtin

    @property
    def testable_on_whole_text(self) -> bool:
        """Whether a text without a match can have no line with one."""
        return self.is_builtin or is_context_free(self.pattern)


@dataclass(frozen=True)
class RuleSet:
    """Rules in evaluation order; a rule's ``ord`` is its 1-based position."""

    rules: tuple[Rule, ...]

    @classmethod
    def builtin(cls) -> RuleSet:
        return cls(tuple(
            Rule(rule_id, name, pattern, severity, description, keywords, needs, category, known=True)
            for category, rule_id, name, severity, pattern, keywords, needs, description
            in catalogue.BUILTIN_RULES
        ))

    def with_rules(self, *rules: Rule) -> RuleSet:
        """This set followed by ``rules``. Ids may repeat."""
        return replace(self, rules=self.rules + tuple(replace(r, known=r.known and r in self.rules) for r in rules))

    def with_custom(self, patterns: Mapping[str, str] | Iterable[tuple[str, str]],
                    spark: SparkSession | None = None) -> RuleSet:
        """This set followed by one rule per (name, regex). A bad regex raises ``ValueError``."""
        items = patterns.items() if isinstance(patterns, Mapping) else patterns
        rules = tuple(
            Rule(custom_rule_id(name), name, regex, catalogue.CUSTOM_SEVERITY, catalogue.CUSTOM_DESCRIPTION)
            for name, regex in items
        )
        _check(rules, spark or SparkSession.getActiveSession())
        return self.with_rules(*rules)

    def __len__(self) -> int:
        return len(self.rules)

    def numbered(self) -> list[tuple[int, Rule]]:
        return list(enumerate(self.rules, start=1))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The rules as a DataFrame. Its size is known to Catalyst, which decides on broadcasting."""
        table = pa.table({
            "ord": pa.array(range(1, len(self.rules) + 1), pa.int32()),
            "rule_id": [r.rule_id for r in self.rules],
            "rule_name": [r.name for r in self.rules],
            "category": [r.category for r in self.rules],
            "severity": [r.severity for r in self.rules],
            "severity_rank": pa.array([SEVERITY_RANK.get(r.severity, 0) for r in self.rules], pa.int32()),
            "pattern": [r.pattern for r in self.rules],
            "keywords": pa.array([list(r.keywords) for r in self.rules], pa.list_(pa.string())),
            "description": [r.description for r in self.rules],
        })
        return spark.createDataFrame(table)


def custom_rule_id(name: str) -> str:
    return "custom-" + name.lower().replace(" ", "-")


def _check(rules: tuple[Rule, ...], spark: SparkSession | None) -> None:
    """Raises ``ValueError`` naming the first pattern that Python or, with a session, Spark cannot compile."""
    for rule in rules:
        if (problem := _python_problem(rule.pattern)) is not None:
            raise ValueError(f"{rule.name}: {rule.pattern!r} is no regular expression ({problem})")
    if spark is not None and rules and not _spark_compiles(rules, spark):
        odd = next((r for r in rules if not _spark_compiles((r,), spark)), rules[0])
        raise ValueError(f"{odd.name}: {odd.pattern!r} has no equivalent that Spark can evaluate")


def _python_problem(pattern: str) -> str | None:
    try:
        re.compile(pattern)
    except re.error as problem:
        return str(problem)
    return None


def _spark_compiles(rules: tuple[Rule, ...], spark: SparkSession) -> bool:
    try:
        spark.range(1).select(*[F.lit("").rlike(rule.java_pattern) for rule in rules]).collect()
    except Exception:  # whatever the JVM has against the pattern
        return False
    return True
