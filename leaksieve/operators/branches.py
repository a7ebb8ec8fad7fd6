"""Which commits a branch holds, found from the commits alone.

First parents make every commit a node of a forest, on which all ancestors of a commit are found by pointer doubling:
the commits 1, 2, 4, 8 … first parents away are tables made by joining the one before with itself, and going
through them from the longest step to the shortest marks a chain of n commits in log2(n) joins. Other parents of what has been
marked, the histories that merges brought in, begin the next round. Rounds are as many as merges are nested, whatever the length
of the history; commits marked before, and with them all that lies behind, are left out at every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leaksieve.plans.scratch import scratch_dir

_KEY = ["repo", "commit_sha"]


def _written(frame: DataFrame, place: str) -> DataFrame:
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)


def _steps(parents: DataFrame, folder: str) -> list[DataFrame]:
    """Tables (repo, commit_sha, ancestor) of the commits 1, 2, 4 … first parents away, as far as chains reach."""
    steps = [_written(parents.where("place = 0").select(*_KEY, F.col("parent").alias("ancestor")).distinct(), f"{folder}/step0")]
    while True:
        last = steps[-1]
        further = last.alias("a").join(
            last.alias("b"), (F.col("a.repo").eqNullSafe(F.col("b.repo"))) & (F.col("a.ancestor") == F.col("b.commit_sha")))
        table = _written(further.select("a.repo", "a.commit_sha", "b.ancestor"), f"{folder}/step{len(steps)}")
        if table.isEmpty():
            return steps
        steps.append(table)


def _without(rows: DataFrame, seen: DataFrame) -> DataFrame:
    return rows.alias("r").join(
        seen.alias("s"), F.col("r.repo").eqNullSafe(F.col("s.repo")) & (F.col("r.commit_sha") == F.col("s.commit_sha")), "left_anti")


def reachable_commits(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """Distinct (repo, commit_sha) of the heads and all their ancestors. Runs its rounds when called.

    ``commits`` has repo, commit_sha and parent_shas, the first parent first; commits may repeat. ``heads`` has repo and commit_sha.
    Parents that are no commit of the table, as at the border of a shallow clone, end a chain.
    """
    folder = f"{scratch_dir(commits.sparkSession)}/branches"
    known = _written(commits.select(*_KEY).where("commit_sha IS NOT NULL").distinct(), f"{folder}/commits")
    parents = commits.select(*_KEY, F.posexplode("parent_shas").alias("place", "parent")).distinct()
    exists = known.alias("k")
    parents = parents.alias("p").join(
        exists, F.col("p.repo").eqNullSafe(F.col("k.repo")) & (F.col("p.parent") == F.col("k.commit_sha")), "left_semi")
    parents = _written(parents, f"{folder}/parents")
    steps = _steps(parents, folder)
    entries = heads.select(*_KEY).distinct().alias("h").join(
        exists, F.col("h.repo").eqNullSafe(F.col("k.repo")) & (F.col("h.commit_sha") == F.col("k.commit_sha")), "left_semi")
    seen = known.limit(0)
    number = 0
    while True:
        marked = entries
        for step in reversed(steps):
            both = marked.alias("m").join(
                step.alias("s"), F.col("m.repo").eqNullSafe(F.col("s.repo")) & (F.col("m.commit_sha") == F.col("s.commit_sha")), "left")
            marked = both.select("m.repo", F.explode(F.array_compact(F.array("m.commit_sha", "ancestor"))).alias("commit_sha")).distinct()
            if number:
                marked = _without(marked, seen)
        new = _written(marked, f"{folder}/round{number}")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new) if number else new
        merged = parents.where("place > 0").alias("p").join(
            new.alias("n"), F.col("p.repo").eqNullSafe(F.col("n.repo")) & (F.col("p.commit_sha") == F.col("n.commit_sha")), "left_semi")
        entries = _without(merged.select("repo", F.col("parent").alias("commit_sha")).distinct(), seen)
        number += 1
