"""``scan_text`` as a table function of SQL."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from leaksieve.deploy import ship_package
from leaksieve.functions.text import LINE_BOUNDARY, MIN_LINE_LENGTH, WHITESPACE
from leaksieve.plans.scan import RESULT_COLUMNS
from leaksieve.rules import SEVERITY_RANK, Rule, RuleSet

_NUMBERS = {"line_number", "ord", "severity_rank"}
_FOUND = [StructField(name, IntegerType() if name in _NUMBERS else StringType()) for name in (
    "line_number", "ord", "rule_id", "rule_name", "severity", "severity_rank", "snippet", "matched_text", "description")]
_BOUNDARY = re.compile(LINE_BOUNDARY)


class _Matcher:
    """The rules on one line, in plain Python."""

    def __init__(self, rules: RuleSet):
        self.rules = [(i, r, re.compile(r.pattern), self._attributes(i, r)) for i, r in rules.numbered()]

    @staticmethod
    def _attributes(number: int, rule: Rule) -> tuple:
        return number, rule.rule_id, rule.name, rule.severity, SEVERITY_RANK.get(rule.severity, 0)

    def candidates(self, text: str, low: str) -> list[tuple]:
        """The rules whose literals the text holds."""
        return [entry for entry in self.rules if self._may_fire(entry[1], text, low)]

    @staticmethod
    def _may_fire(rule: Rule, text: str, low: str) -> bool:
        held = low if rule.ignores_case else text
        return all(need in held for need in rule.needs) and (not rule.keywords or any(k in low for k in rule.keywords))

    def findings(self, text: str) -> Iterator[tuple]:
        candidates = self.candidates(text, text.lower())
        if not candidates:
            return
        lines = _BOUNDARY.split(text)
        plain, low = _Lines(lines), _Lines([line.lower() for line in lines])
        hits = []
        for number, rule, pattern, attributes in candidates:
            held = [(low if rule.ignores_case else plain).holding(need) for need in rule.needs]
            if rule.keywords:
                held.append(set().union(*map(low.holding, rule.keywords)))
            for i in set.intersection(*held) if held else range(len(lines)):
                if match := pattern.search(lines[i]):
                    hits.append((i, number, attributes, match[0], rule.description))
        hits.sort(key=itemgetter(0, 1))
        for i, same in groupby(hits, itemgetter(0)):
            snippet = lines[i].strip(WHITESPACE)
            if len(snippet) >= MIN_LINE_LENGTH:
                for _, _, attributes, matched, description in same:
                    yield (i + 1, *attributes, snippet, matched, description)


class _Lines:
    """Which lines hold a literal, found by one search of all lines together and kept for the rules that share it."""

    def __init__(self, lines: list[str]):
        self.whole = "\n".join(lines)
        self.starts = list(accumulate((len(line) + 1 for line in lines), initial=0))
        self.known: dict[str, set[int]] = {}

    def holding(self, literal: str) -> set[int]:
        found = self.known.get(literal)
        if found is None:
            found = self.known[literal] = set()
            # A line holds no boundary, nor does a literal that it holds.
            at = -1 if "\n" in literal else self.whole.find(literal)
            while at >= 0:
                i = bisect_right(self.starts, at) - 1
                found.add(i)
                at = self.whole.find(literal, self.starts[i + 1])
        return found


def scan_function(rules: RuleSet) -> type:
    """The class of a table function that scans the rows of a table argument with the rules."""

    class ScanText:
        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(rows.dataType, StructType):
                raise ValueError("the first argument must be TABLE(...)")
            if not text.isConstantExpression or text.value not in rows.dataType.names:
                raise ValueError("the second argument must name the column to scan")
            if rows.dataType[text.value].dataType != StringType():
                raise ValueError(f"{text.value} is no string column")
            kept = [field for field in rows.dataType.fields if field.name != text.value]
            taken = sorted({field.name for field in kept} & RESULT_COLUMNS)
            if taken:
                raise ValueError(f"Columns of the input are named like results: {taken}")
            return AnalyzeResult(schema=StructType([*kept, *_FOUND]))

        def __init__(self):
            self.matcher = _Matcher(rules)

        def eval(self, row, text: str):
            if row[text] is not None:
                kept = tuple(value for name, value in zip(row.__fields__, row) if name != text)
                for found in self.matcher.findings(row[text]):
                    yield (*kept, *found)

    return ScanText


def register_functions(spark: SparkSession, rules: RuleSet | None = None, name: str = "scan_text") -> None:
    """Makes ``SELECT * FROM scan_text(TABLE(docs), 'text')`` available: the rows of ``scan_text`` over any table argument.

    Rows are scanned where they are: nothing is shuffled unless the caller partitions the argument. The rules run in Python here,
    behind the same literal tests; ``leaksieve.scan_text`` evaluates them in the JVM and is several times faster.
    """
    ship_package(spark)
    spark.udtf.register(name, udtf(scan_function(rules or RuleSet.builtin()), useArrow=True))
