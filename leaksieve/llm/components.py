"""Connected components by alternating large and small stars; every round is a join and a rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leaksieve.llm.shared import discard, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _star(edges: DataFrame, keep) -> DataFrame:
    """Hangs every node that ``keep`` names below the smallest node of its neighbourhood.

    The smallest neighbour comes from a rollup with partial sums and is joined back, so that a hub
    with many links is never gathered in one place.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of a link; the component is its smallest node.

    Links may repeat, point either way or to the node itself. Nothing is gathered on the driver but
    a count and a checksum per round, by which the end is seen; each round is written to the shared
    folder, so a lost executor costs one round.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        large = _star(edges, F.col("v") > F.col("u")).where("u <> v").distinct()
        ordered = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ordered.groupBy("u").agg(F.min("v").alias("m"))
        small = ordered.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        previous, edges = edges, written(small.where("u <> v").distinct())
        discard(previous)
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
