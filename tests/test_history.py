from pyspark.sql import functions as F

from leaksieve import Rule, RuleSet
from leaksieve.operators.history import first_occurrences, newest_commits
from leaksieve.plans.sources import scan_history
from leaksieve.sources.patches import read_git_log

PATCH = "repo string, commit_sha string, parent_sha string, seq long, author string, committed_at string, " \
        "file_path string, patch_pos int, patch string"
SECRET = "pwd = 'abcdefghij'"


def patches(spark, rows):
    return spark.createDataFrame([(repo, sha, None, seq, who, when, path, pos, patch)
                                  for repo, sha, seq, who, when, path, pos, patch in rows], PATCH)


def test_added_lines_and_dedup(spark):
    text = f"@@ -1 +1 @@\n+{SECRET} first\n {SECRET}ctx\n-pwd = 'removed!!'\n+{SECRET} again\n+++ pwd = 'plusplus1'\n+short"
    scan = scan_history(patches(spark, [
        ("r", "a" * 40, 0, "Ann", "2024", "x.py", 0, text),
        ("r", "b" * 40, 1, None, None, "x.py", 0, f"+{SECRET}"),
        ("r", "b" * 40, 1, None, None, "y.py", 1, f"+\t{SECRET}\x0b+pwd = 'abcdefgh12'"),
        ("r", "b" * 40, 1, None, None, None, 2, "+pwd = 'deleted12'"),
        ("q", "a" * 40, 0, "Ann", "2024", "x.py", 0, f"+{SECRET}"),
    ]))
    got = {(r.target, r.commit_sha[0], r.file_path, r.snippet, r.commit_author, r.commit_date, r.line_number, r.source_type)
           for r in scan.findings.collect()}
    assert got == {
        ("r", "a", "x.py", SECRET + " first", "Ann", "2024", 0, "history"),
        ("r", "b", "x.py", SECRET, "unknown", "", 0, "history"),
        ("r", "b", "y.py", SECRET, "unknown", "", 0, "history"),
        ("r", "b", "y.py", "pwd = 'abcdefgh12'", "unknown", "", 0, "history"),
        ("q", "a", "x.py", SECRET, "Ann", "2024", 0, "history"),
    }
    assert scan.scan_log.count() == 3


def test_plus_plus_lines_on_request(spark):
    frame = patches(spark, [("r", "a", 0, "A", "d", "x", 0, "+++ pwd = 'plusplus1'")])
    assert scan_history(frame).findings.count() == 0
    assert scan_history(frame, keep_plus_plus=True).findings.count() == 1


def test_branch(spark):
    frame = patches(spark, [("r", c, i, "A", "d", "x", 0, "+" + SECRET) for i, c in enumerate("abc")])
    frame = frame.withColumn("branch", F.when(F.col("seq") == 1, "dev").otherwise("main"))
    assert [r.commit_sha for r in scan_history(frame, branch="dev").findings.collect()] == ["b"]
    assert scan_history(frame).findings.count() == 3


def test_depth(spark):
    """Repositories of very different sizes, files repeated per commit, gaps and negatives in seq."""
    rows = [("big", 3 * i - 50) for i in range(20_000)] + [("big", 3 * i - 50) for i in range(500)]
    rows += [("wide", i << 40) for i in range(50)] + [("small", 7), ("small", 9)]
    frame = spark.createDataFrame(rows, "repo string, seq long")
    for depth in (1, 2, 7, 50, 8192, 8193, 19_999, 20_000, 30_000):
        got = {(r.repo, r.seq) for r in newest_commits(frame, depth).collect()}
        expected = set()
        for repo in ("big", "wide", "small"):
            expected |= {(repo, s) for s in sorted({s for name, s in rows if name == repo})[:depth]}
        assert got == expected, depth
    for depth in (1, 700, 19_999):
        got = newest_commits(frame, depth)
        assert got.where("repo = 'big'").select("seq").distinct().count() == depth
        assert got.where("repo = 'small'").count() == min(depth, 2)
    assert newest_commits(frame, None).count() == len(rows)
    assert newest_commits(frame, 0).count() == 0
    assert newest_commits(frame, 600).where("repo = 'big'").count() == 600 + 500


def test_dedup_keeps_the_first(spark):
    rows = [("t", "f", "r", "m", "c", p, l, f"s{p}-{l}") for p in (2, 1) for l in (5, 3)]
    frame = spark.createDataFrame(rows, "target string, file_path string, rule_id string, matched_text string, "
                                        "commit_sha string, patch_pos int, line_pos int, snippet string")
    assert [r.snippet for r in first_occurrences(frame).collect()] == ["s1-3"]
    assert first_occurrences(frame).columns == frame.columns


COMMIT = """commit {sha} {parent}(HEAD -> main)
Merge: 1 2
Author:     Ann Lee <a@x>
AuthorDate: 2024-01-01T00:00:00+00:00
Commit:     Bob <b@x>
CommitDate: 2024-01-02T00:00:00+00:00

    commit message
    diff --git a/no b/no

diff --git a/x {n}.py b/x {n}.py
index 1..2 100644
--- a/x {n}.py
+++ b/x {n}.py
@@ -1 +1,2 @@
 a
+commit pwd = 'abcdefghij'
-diff --git pwd = 'removed11'
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-pwd = 'abcdefghij'
diff --git a/old.py b/new.py
similarity index 100%
rename from old.py
rename to new.py
"""


def test_git_log(spark, tmp_path):
    n = 400
    log = "\n".join(COMMIT.format(sha=f"{i:040x}", parent=f"{i + 1:040x} " if i < n - 1 else "", n=i) for i in range(n))
    path = tmp_path / "r.log"
    path.write_text(log)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # Small splits: records cross their borders.
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        frame = read_git_log(spark, str(path), "r")
        assert frame.rdd.getNumPartitions() > 5
        rows = frame.collect()
        assert len(rows) == 3 * n
        commits = sorted({(r.seq, r.commit_sha) for r in rows})
        assert [sha for _, sha in commits] == [f"{i:040x}" for i in range(n)]
        assert {(r.author, r.committed_at) for r in rows} == {("Ann Lee", "2024-01-02T00:00:00+00:00")}
        assert {r.commit_sha: r.parent_sha for r in rows}[f"{5:040x}"] == f"{6:040x}"
        assert {r.commit_sha: r.parent_sha for r in rows}[f"{n - 1:040x}"] is None
        assert {r.file_path for r in rows if r.commit_sha == f"{3:040x}"} == {"x 3.py", None, "new.py"}
        found = scan_history(frame, depth=10).findings.collect()
        assert sorted(r.file_path for r in found) == sorted(f"x {i}.py" for i in range(10))
        assert {r.snippet for r in found} == {"commit pwd = 'abcdefghij'"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_and_changes_that_cannot_be_parsed(spark, tmp_path):
    good = COMMIT.format(sha="a" * 40, parent="", n=1)
    log = "\n".join([good, "commit not-a-sha\nAuthor:     X\n\n    text", "commit " + "b" * 40 + " \n\n    merge\n\n"
                     "diff --cc both.py\nindex 1,2..3\n--- a/both.py\n+++ b/both.py\n@@@ -1,1 -1,1 +1,2 @@@\n++pwd = 'abcdefghij'\n"])
    path = tmp_path / "r.log"
    path.write_text(log)
    scan = scan_history(read_git_log(spark, str(path), "r"))
    errors = {(r.source_type, r.target, r.source_id, r.stage, r.message) for r in scan.errors.collect()}
    assert errors == {("history", "r", None, "parse", "Cannot parse record"),
                      ("history", "r", "b" * 40, "parse", "Cannot parse change: diff --cc both.py")}
    assert {r.file_path for r in scan.findings.collect()} == {"x 1.py"}
    assert {r.source_id for r in scan.scan_log.collect()} == {"a" * 40, "b" * 40}


def test_rules_of_one_id_are_deduplicated_together(spark):
    rules = RuleSet((Rule("twin", "One", r"tok-\d+", "low"), Rule("twin", "Two", r"tok-[0-9]+", "high")))
    frame = patches(spark, [("r", "a", 0, "A", "d", "x", 0, "+line with tok-123\n+again with tok-123")])
    assert [(r.rule_name, r.snippet) for r in scan_history(frame, rules).findings.collect()] == [("One", "line with tok-123")]


def test_depth_keeps_patches_without_repository_or_seq(spark):
    rows = [(None, 5), (None, 3), (None, 8), ("r", None), ("r", 1), ("r", 2), ("r", 2), (None, None)]
    frame = spark.createDataFrame(rows, "repo string, seq long")
    for depth, expected in ((10, rows), (1, [(None, 3), ("r", None), ("r", 1), (None, None)])):
        got = [tuple(r) for r in newest_commits(frame, depth).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))
