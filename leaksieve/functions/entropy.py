"""Shannon entropy of strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a high-entropy token.
MIN_TOKEN_LENGTH = 16
DEFAULT_THRESHOLD = 4.5


def shannon_entropy(text: Column, charset: str = "") -> Column:
    """Bits per character over the distinct characters of ``text``.

    With a ``charset`` only its characters contribute, each still weighted by the full length.
    """
    length = F.length(text)
    characters = F.array_distinct(F.split(text, ""))
    if charset:
        characters = F.filter(characters, lambda c: F.contains(F.lit(charset), c) & (c != ""))

    def add(total: Column, char: Column) -> Column:
        share = (length - F.length(F.replace(text, char, F.lit("")))) / length
        return total - share * F.log2(share)

    bits = F.aggregate(characters, F.lit(0.0), add)
    return F.when(length == 0, F.lit(0.0)).otherwise(bits)


def is_high_entropy(token: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.when(F.length(token) < MIN_TOKEN_LENGTH, F.lit(False)).otherwise(shannon_entropy(token) >= threshold)
