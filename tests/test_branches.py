import random

import pytest

from leaksieve.operators import branches
from leaksieve.operators.branches import reachable_commits
from leaksieve.plans.sources import scan_history

COMMITS = "repo string, commit_sha string, parent_shas array<string>"
HEADS = "repo string, commit_sha string"


def brute_force(commits, heads):
    parents = {(r, c): ps for r, c, ps in commits if c is not None}
    stack, seen = [h for h in heads if h in parents], set()
    while stack:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            stack += [(node[0], p) for p in parents[node] or () if (node[0], p) in parents]
    return seen


def result(spark, commits, heads):
    rows = reachable_commits(spark.createDataFrame(commits, COMMITS).repartition(4), spark.createDataFrame(heads, HEADS)).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    commits = []
    for repo in ("a", "b", None):
        for i in range(60):
            older = [f"{j}" for j in range(i + 1, 60)]
            commits.append((repo, f"{i}", rng.sample(older[:6], min(len(older[:6]), rng.choice([0, 1, 1, 1, 1, 2, 3])))))
    commits += [commits[0], ("a", "x", ["gone", "5"]), ("a", "y", None), (None, None, ["3"])]
    heads = [("a", "x"), ("b", "7"), ("b", "9"), (None, "0"), ("c", "1"), ("a", "nowhere")]
    found = result(spark, commits, heads)
    assert found == brute_force(commits, heads) and 20 < len(found) < len(commits)


def test_long_chain_takes_few_rounds(spark, tmp_path, monkeypatch):
    n = 3000
    commits = [("r", f"{i}", [f"{i + 1}"] + ([f"s{i}"] if i % 7 == 0 else [])) for i in range(n)] + [("r", f"s{i}", [f"{i + 3}"]) for i in range(n)]
    monkeypatch.setattr(branches, "scratch_dir", lambda spark: str(tmp_path))
    assert result(spark, commits, [("r", "10")]) == brute_force(commits, [("r", "10")])
    names = sorted(p.name for p in tmp_path.glob("branches/*"))
    assert [n for n in names if n.startswith("round")] == ["round0", "round1", "round2"]
    assert sum(n.startswith("step") for n in names) == 13


def test_no_heads_and_no_commits(spark):
    assert result(spark, [("r", "1", ["2"]), ("r", "2", [])], []) == set()
    assert result(spark, [], [("r", "1")]) == set()


def test_branch_and_depth(spark):
    schema = ("repo string, commit_sha string, parent_shas array<string>, seq long, author string, committed_at string, file_path string, "
              "patch_pos int, patch string")
    rows = [("r", c, p, i, "A", "d", "f.py", 0, f"+pwd = 'secret-{c}'") for i, (c, p) in enumerate(
        [("m3", ["m2", "t1"]), ("t2", ["t1"]), ("t1", ["m1"]), ("m2", ["m1"]), ("m1", [])])]
    patches = spark.createDataFrame(rows, schema)
    heads = spark.createDataFrame([("r", "main", "m3"), ("r", "topic", "t2"), ("q", "main", "m1")], "repo string, branch string, commit_sha string")

    def commits(**options):
        scan = scan_history(patches, heads=heads, **options)
        assert {r.source_id for r in scan.scan_log.collect()} == {r.commit_sha for r in scan.findings.collect()}
        return {r.commit_sha for r in scan.findings.collect()}

    assert commits(branch="main") == {"m3", "t1", "m2", "m1"}
    assert commits(branch="topic", depth=2) == {"t2", "t1"}
    assert commits() == {"m3", "t2", "t1", "m2", "m1"}


def test_no_text_is_moved_to_find_a_branch(spark):
    """Where the commits of a branch are too many to be broadcast, findings are joined with them, not patches."""
    rows = [("r", f"c{i}", [f"c{i + 1}"], i, "A", "d", "x.py", f"+token = 'abcdefgh{i}'\n") for i in range(40)]
    rows += [("r", "side", ["c3"], 50, "A", "d", "x.py", "+token = 'aside1234'\n")]
    patches = spark.createDataFrame(rows, "repo string, commit_sha string, parent_shas array<string>, seq long, author string, committed_at string, "
                                    "file_path string, patch string")
    heads = spark.createDataFrame([("r", "main", "c5")], "repo string, branch string, commit_sha string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for depth, last in ((None, 40), (3, 8)):
            scan = scan_history(patches, heads=heads, branch="main", depth=depth)
            assert sorted(r.commit_sha for r in scan.findings.collect()) == sorted(f"c{i}" for i in range(5, last))
            assert scan.scan_log.count() == last - 5
        found = scan_history(patches, heads=heads, branch="main").findings
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "patch#" not in "".join(line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line)
        joins = found._jdf.queryExecution().optimizedPlan().toString()
        assert joins.index("LeftSemi") < joins.index("Generate")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
