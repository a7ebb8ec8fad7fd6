"""Filters of bounded size: which rows may have a key that another table has, found without moving the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Words of 64 bits in a filter: one for two keys, and at most so many.
FILTER_WORDS = 1 << 22
_PART_BITS = 10


def may_hold(keys: DataFrame, *columns: str) -> Column:
    """Whether ``keys``, which has these columns, may have a row's values of them: true for all it has, and for few others.

    Nulls are values here. Counts the keys when called; the filter is made when the plan runs.
    """
    keys = keys.select(*columns).distinct()
    spark, words = keys.sparkSession, 1 << _PART_BITS
    while words < min(FILTER_WORDS, keys.count() // 2):
        words *= 2
    hashed = F.xxhash64(*columns)
    place = hashed.bitwiseAND(words - 1)
    # Four bits of one word for each key.
    mask = reduce(Column.bitwiseOR, [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(hashed, shift).bitwiseAND(63).cast("int")) for shift in (32, 38, 44, 50)])
    taken = keys.groupBy(place.alias("id")).agg(F.bit_or(mask).alias("bits"))
    parts = spark.range(words).join(taken, "id", "left").groupBy(F.shiftright("id", _PART_BITS).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))["bits"].alias("bits"))
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("part", "bits")))["bits"].alias("parts")).scalar()
    held = parts[F.shiftright(place, _PART_BITS).cast("int")][place.bitwiseAND((1 << _PART_BITS) - 1).cast("int")]
    return held.bitwiseAND(mask) == mask
