"""Masking of secrets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters left visible, and the most mask characters written.
VISIBLE = 6
VISIBLE_WHEN_SHORT = 2
MAX_MASK = 20


def redact(text: Column, ellipsis: bool = False) -> Column:
    """Keeps the first characters and masks the rest; ``ellipsis`` marks long texts with ``…``."""
    length = F.length(text)
    short = F.concat(F.left(text, F.lit(VISIBLE_WHEN_SHORT)),
                     F.repeat(F.lit("*"), F.greatest(length - VISIBLE_WHEN_SHORT, F.lit(0))))
    long = F.concat(F.left(text, F.lit(VISIBLE)),
                    F.repeat(F.lit("*"), F.least(length - VISIBLE, F.lit(MAX_MASK))))
    if ellipsis:
        long = F.concat(long, F.lit("…"))
    return F.when(length <= VISIBLE, short).otherwise(long)


def redact_snippet(snippet: Column, matched: Column) -> Column:
    """``snippet`` with the first occurrence of ``matched`` masked, if it occurs."""
    at = F.position(matched, snippet)
    masked = F.overlay(snippet, redact(matched, ellipsis=True), at, F.length(matched))
    return F.when((F.length(matched) > 0) & (at > 0), masked).otherwise(snippet)


def redact_all(snippet: Column, matches: Column) -> Column:
    """``snippet`` with every text of the array ``matches`` masked wherever it occurs, longest first."""
    longest_first = F.array_sort(F.transform(
        F.array_distinct(matches), lambda m: F.struct((-F.length(m)).alias("order"), m.alias("text"))))
    return F.aggregate(longest_first, snippet, lambda acc, m: F.when(
        F.length(m["text"]) > 0, F.replace(acc, m["text"], redact(m["text"], ellipsis=True))).otherwise(acc))
