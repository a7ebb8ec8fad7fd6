"""Commit patches from ``git log -p`` exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leaksieve.functions.text import decode_lenient

PATCH_COLUMNS = ("repo", "commit_sha", "parent_sha", "seq", "author", "committed_at", "file_path",
                 "patch_pos", "patch", "problem", "parent_shas")


def read_git_log(spark: SparkSession, path: str, repo: Column | str) -> DataFrame:
    """Patches from ``git log -p --diff-merges=first-parent --parents --format=fuller --date=iso-strict``
    (with ``core.quotePath`` off).

    Commits become the rows of a splittable text scan, so one large export is parsed by many
    tasks. ``repo`` is a name or an expression, for instance over ``_metadata.file_name``; a
    repository's export is one file, whose order gives ``seq``.
    """
    repo = F.lit(repo) if isinstance(repo, str) else repo
    commits = (spark.read.option("lineSep", "\ncommit ").text(path)
               .select(repo.alias("repo"), F.col("_metadata.file_block_start").alias("__block"),
                       F.monotonically_increasing_id().alias("__row"),
                       decode_lenient(F.col("value").cast("binary")).alias("value")))
    return parse_commits(commits)


def parse_commits(commits: DataFrame) -> DataFrame:
    """One row per changed file. ``commits`` has repo, __block, __row and the commit's text as value.

    A record without a commit id, and a change in another form than ``diff --git`` (a merge's combined
    diff), is a row without a path that says so in ``problem``; blank records are left out.
    """
    value = F.col("value")
    text = F.when(value.startswith("commit "), F.substring(value, 8, 2**31 - 1)).otherwise(value)
    head = F.substring_index(text, "\n\n", 1)
    ids = F.split(F.substring_index(head, "\n", 1), " ")
    commits = commits.select(
        "repo", "__block", "__row",
        ids[0].alias("commit_sha"),
        F.slice(F.filter(ids, _is_sha), 2, 2**30).alias("parent_shas"),
        _header(head, "Author").alias("__author"),
        F.coalesce(_header(head, "CommitDate"), _header(head, "Date")).alias("committed_at"),
        F.split(text, r"\ndiff --(?=(?:git|cc|combined) )").alias("__files"), F.length(F.trim(value)).alias("__length"))
    commits = commits.where("__length > 0").withColumn(
        "commit_sha", F.when(_is_sha(F.col("commit_sha")), F.col("commit_sha")))
    changes = F.when(F.col("commit_sha").isNotNull(), F.slice("__files", 2, F.greatest(F.size("__files") - 1, F.lit(0))))
    files = commits.select(
        "repo", "commit_sha", "parent_shas", "__block", "__row", "committed_at",
        F.trim(F.regexp_replace("__author", r"\s*<[^>]*>\s*$", "")).alias("author"),
        F.posexplode_outer(changes).alias("patch_pos", "__file"))
    plain = F.startswith("__file", F.lit("git "))
    header = F.when(plain, F.substring(F.substring_index("__file", _HUNK, 1), 5, 2**31 - 1))
    problem = F.when(F.col("commit_sha").isNull(), F.lit("Cannot parse record")).when(
        ~plain, F.concat(F.lit("Cannot parse change: diff --"), F.substring_index("__file", "\n", 1)))
    return files.select(
        "repo", "commit_sha", F.get("parent_shas", F.lit(0)).alias("parent_sha"),
        # Block offset and row within the task, in file order: a row takes far more than 2^-20 bytes.
        (F.shiftleft(F.col("__block"), 20) + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).alias("seq"),
        "author", "committed_at", new_path(header).alias("file_path"), "patch_pos",
        F.substring("__file", F.length(header) + 6, F.length("__file")).alias("patch"), problem.alias("problem"), "parent_shas")


_HUNK = "\n@@ "


def _is_sha(word: Column) -> Column:
    return F.rlike(word, F.lit("^[0-9a-f]{7,64}$"))


def _header(head: Column, name: str) -> Column:
    value = F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.when(F.length(value) > 0, value)


def new_path(header: Column) -> Column:
    """The path after the change, null for a deleted file; ``header`` is the file's part before its first hunk."""
    plus = F.regexp_extract(header, r"(?m)^\+\+\+ (?:\"?b/)?(.*?)\"?\t?$", 1)
    renamed = F.regexp_extract(header, r"(?m)^rename to (.*)$", 1)
    named = F.regexp_extract(header, r"\A\"?a/(?:.*) \"?b/(.*?)\"?(?:\n|\z)", 1)
    deleted = F.rlike(header, F.lit(r"(?m)^(?:deleted file mode|\+\+\+ /dev/null)"))
    return F.when(header.isNull() | deleted, F.lit(None)).otherwise(
        F.when(plus != "", plus).when(renamed != "", renamed).when(named != "", named))
