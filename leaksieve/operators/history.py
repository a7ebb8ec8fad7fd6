"""Operators of commit history: newest-commit limit and first-occurrence dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DEDUP_KEY = ("target", "file_path", "rule_id", "matched_text", "commit_sha")

# Blocks of consecutive ``seq`` values in which commits are counted: 2^13 to a block, 2^13 blocks to
# a larger one.
_BLOCK_BITS = 13


def _holding_cut(counts: DataFrame) -> DataFrame:
    """Of (repo, block, n, need): each repository's block with its ``need``-th commit, and the need within."""
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy("repo").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before)
    return counts.where("before < need AND before + n >= need").selectExpr("repo", "block", "need - before AS need")


def cut_offs(commits: DataFrame, depth: int) -> DataFrame:
    """(repo, last): the ``seq`` of the ``depth``-th commit of every repository that has so many.

    ``commits`` are distinct (repo, seq). Counts per block lead to the block with the cut-off, and
    only its commits are looked at one by one: no task sorts all commits of a large repository.
    """
    blocks = commits.groupBy("repo", F.shiftright("seq", _BLOCK_BITS).alias("block")).agg(F.count("*").alias("n"))
    larger = blocks.groupBy("repo", F.shiftright("block", _BLOCK_BITS).alias("block")).agg(F.sum("n").alias("n"))
    large_cut = _holding_cut(larger.withColumn("need", F.lit(depth).cast("long")))
    cut = _holding_cut(blocks.alias("b").join(
        large_cut.alias("c"),
        F.col("b.repo").eqNullSafe(F.col("c.repo")) & (F.shiftright("b.block", _BLOCK_BITS) == F.col("c.block"))
    ).select("b.repo", "b.block", "b.n", "c.need"))
    near = commits.alias("b").join(
        cut.alias("c"),
        F.col("b.repo").eqNullSafe(F.col("c.repo")) & (F.shiftright("b.seq", _BLOCK_BITS) == F.col("c.block")))
    last = _holding_cut(near.select("b.repo", F.col("b.seq").alias("block"), F.lit(1).alias("n"), "c.need"))
    return last.select("repo", F.col("block").alias("last"))


def newest_commits(patches: DataFrame, depth: int | None, counted: DataFrame | None = None) -> DataFrame:
    """The patches of the ``depth`` newest commits of every repository, or of those that the patches ``counted`` have.

    ``seq`` is an integer, unique per commit of a repository and ascending from the newest. Patches without a
    repository are one repository's; those without a ``seq`` stay and count for no depth. One lazy
    plan: the commits to keep are joined by repository and commit, so that a large repository
    spreads over many tasks; Spark broadcasts them if they turn out to be few.
    """
    if depth is None:
        return patches
    if depth <= 0:
        return patches.limit(0)
    commits = (patches if counted is None else counted).select("repo", F.col("seq").cast("long").alias("seq")).distinct()
    last = cut_offs(commits.where("seq IS NOT NULL"), depth).alias("l")
    kept = commits.alias("c").join(last, F.col("c.repo").eqNullSafe(F.col("l.repo")), "left").where("last IS NULL OR seq IS NULL OR seq <= last")
    kept = kept.select("c.repo", "seq").alias("k")
    return patches.alias("p").join(
        kept, F.col("p.repo").eqNullSafe(F.col("k.repo")) & F.col("p.seq").eqNullSafe(F.col("k.seq")), "left_semi")


def first_occurrences(findings: DataFrame, order: tuple[str, ...] = ("patch_pos", "line_pos"),
                      key: tuple[str, ...] = DEDUP_KEY) -> DataFrame:
    """One finding per dedup key, the first by ``order``.

    An aggregation with map-side partial results rather than a window: a secret that repeats
    in many rows is reduced before the shuffle. Rules may be numbers here; their texts are joined later.
    """
    rest = [*order, *[c for c in findings.columns if c not in key and c not in order]]
    first = F.min(F.struct(*rest)).alias("__first")
    return findings.groupBy(*key).agg(first).select(
        *[F.col(c) if c in key else F.col(f"__first.{c}").alias(c) for c in findings.columns])
