"""Scans of source trees, commit history, hosted repositories and text tables."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from leaksieve.functions.text import decode_lenient
from leaksieve.operators.branches import reachable_commits
from leaksieve.operators.files import ScanConfig
from leaksieve.operators.history import first_occurrences, newest_commits
from leaksieve.operators.merge import ERROR_SCHEMA, FINDING_COLUMNS, LOG_SCHEMA, canonical, union_all
from leaksieve.plans.filters import may_hold
from leaksieve.plans.scan import attach_rules, find_hits
from leaksieve.rules import RuleSet
from leaksieve.sources.payloads import decode_payloads, on_branch, select_payloads
from leaksieve.sources.ranges import read_ranges
from leaksieve.sources.tree import ignore_patterns, list_tree, listed_files, read_files, select_files, tree_found, tree_kind


_FINDINGS = ", ".join(f"{name} {kind}" for name, kind in FINDING_COLUMNS)
# What a scan gives, by the ``kind`` of a tagged row.
_KINDS = {"finding": _FINDINGS, "log": LOG_SCHEMA, "error": ERROR_SCHEMA}
TAGGED_SCHEMA = f"{_FINDINGS}, stage string, message string, kind string"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


@dataclass(frozen=True)
class Scan:
    """Results of a scan: lazy ones, or the tables that ``written`` made of them and the seconds that took.

    Write a scan before feeding several sinks from it. ``tagged`` has findings, log and error rows together, by ``kind``, where one
    read of the sources gives them all.
    """

    findings: DataFrame
    scan_log: DataFrame
    errors: DataFrame
    duration_seconds: float = 0.0
    tagged: DataFrame | None = None

    @classmethod
    def of_tagged(cls, tagged: DataFrame, duration_seconds: float = 0.0) -> Scan:
        parts = [tagged.where(F.col("kind") == kind).select(*_names(schema)) for kind, schema in _KINDS.items()]
        return cls(*parts, duration_seconds, tagged)

    def _together(self) -> DataFrame:
        if self.tagged is not None:
            return self.tagged.select(*_names(TAGGED_SCHEMA))
        parts = zip((self.findings, self.scan_log, self.errors), _KINDS)
        whole = self.findings.sparkSession.createDataFrame([], TAGGED_SCHEMA)
        for frame, kind in parts:
            whole = whole.unionByName(frame.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        return whole

    def merge(self, *others: Scan) -> Scan:
        """All findings, log and error rows; durations add up."""
        scans = (self, *others)
        return Scan(union_all(s.findings for s in scans), union_all(s.scan_log for s in scans),
                    union_all(s.errors for s in scans), sum(s.duration_seconds for s in scans),
                    union_all(s._together() for s in scans))

    def written(self, folder: str) -> Scan:
        """Runs the scan into a table below ``folder``, divided by kind; the scan over it knows its duration.

        Every source that can is read once, so that findings, log and errors agree even if it changes meanwhile.
        """
        start = time.perf_counter()
        whole = self._together()
        whole.write.partitionBy("kind").parquet(folder)
        table = whole.sparkSession.read.schema(TAGGED_SCHEMA).parquet(folder)
        return Scan.of_tagged(table, self.duration_seconds + time.perf_counter() - start)

    def summary(self) -> DataFrame:
        """One row: files_scanned (files, rows or commits), error_count and duration_seconds."""
        count = F.count("*").alias("n")
        return self.scan_log.agg(F.count("*").alias("files_scanned")).select(
            "files_scanned", self.errors.agg(count).scalar().alias("error_count"),
            F.lit(float(self.duration_seconds)).alias("duration_seconds"))


def _no_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ERROR_SCHEMA)


def scan_table(df: DataFrame, text: str, source_id: str, target: str, rules: RuleSet | None = None, *,
               partitions: int | None = None) -> Scan:
    """A scan of any table with a text column; ``source_id`` names a row."""
    rules = rules or RuleSet.builtin()
    rows = df.select(F.col(source_id).cast("string").alias("source_id"), F.col(text).alias("text"))
    found = attach_rules(find_hits(rows, "text", rules, partitions=partitions), rules)
    findings = canonical(found, source_type=F.lit("table"), target=F.lit(target), file_path=F.col("source_id"))
    return Scan(findings, _log(rows, "table", F.lit(target)), _no_errors(df.sparkSession))


def _log(rows: DataFrame, source_type: str, target) -> DataFrame:
    return rows.select(F.lit(source_type).alias("source_type"), target.cast("string").alias("target"), "source_id")


def scan_tree(spark: SparkSession, path: str, rules: RuleSet | None = None,
              config: ScanConfig = ScanConfig()) -> Scan:
    """A scan of the files below ``path``, or of ``path`` itself if it is a file. A directory is listed when called.

    A single file is read in ranges of ``config.range_bytes``, each by a task of its own. Directories that cannot be
    listed are error rows of stage ``list``, files that cannot be read of stage ``read``.
    """
    kind = tree_kind(path, config.lister)
    if kind is None:
        return Scan.of_tagged(_error_rows(spark.range(1), path, "list", None, F.lit(f"Path not found: {path}")))
    if kind == "file":
        name = list_tree(spark, path, config).select("rel_path").first().rel_path
        return _scan_single(read_ranges(spark, path, config.range_bytes, config.lister), path, name, config.range_bytes, rules)
    found = tree_found(spark, path, config)
    selected = select_files(listed_files(found), ignore_patterns(path, config), config)
    scan = scan_files(read_files(selected, root=path, lister=config.lister), path, rules)
    refused = _error_rows(found.where("kind = 'error'"), path, "list", F.col("rel_path"), F.col("message"))
    return Scan.of_tagged(scan.tagged.unionByName(refused))


def _error_rows(rows: DataFrame, target: str, stage: str, source_id, message) -> DataFrame:
    """Tagged rows of errors of a tree."""
    return _tagged(rows.select(F.lit("error").alias("kind"), F.lit(stage).alias("stage"), message.alias("message"),
                               (F.lit(None) if source_id is None else source_id).cast("string").alias("source_id")), target)


def _tagged(rows: DataFrame, target: str) -> DataFrame:
    """Rows with a ``kind`` and some of the columns of findings, in the form of ``TAGGED_SCHEMA``."""
    pick = {"source_type": F.lit("tree"), "target": F.lit(target)}
    columns = [(pick[c] if c in pick else F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
               for c, kind in (*FINDING_COLUMNS, ("stage", "string"), ("message", "string"), ("kind", "string"))]
    return rows.select(*columns)


def scan_files(files: DataFrame, target: str, rules: RuleSet | None = None) -> Scan:
    """A scan of files as ``read_files`` returns them: rel_path, single, content, status. Each is read once.

    A file of a tree that cannot be opened is left out like a binary one, and becomes an error row.
    """
    kinds = F.when(F.col("status") == "ok", F.array(F.lit("finding"), F.lit("log"))).when(
        F.col("status") == "unreadable", F.when(F.col("single"), F.array(F.lit("error"), F.lit("log"))).otherwise(F.array(F.lit("error"))))
    rows = files.select(F.col("rel_path").alias("file_path"), "content", F.explode(kinds).alias("kind"), F.lit(0).cast("long").alias("lines_before"))
    failed = F.concat(F.lit("Error scanning "), F.col("file_path"))
    return _scan_rows(rows, failed, target, rules)


def _scan_single(pieces: DataFrame, target: str, name: str, range_bytes: int, rules: RuleSet | None) -> Scan:
    """A scan of the pieces of one file (``read_ranges``)."""
    log = F.when(F.col("first"), F.array(F.lit("log"))).otherwise(F.array().cast("array<string>"))
    kinds = F.concat(F.array(F.when(F.col("status") == "ok", "finding").otherwise("error")), log)
    rows = pieces.select(F.lit(name).alias("file_path"), "range", "content", F.explode(kinds).alias("kind"), "lines_before")
    failed = F.concat(F.lit(f"Error scanning {name}"), F.when(F.col("range") > 0, F.concat(
        F.lit(" from byte "), (F.col("range") * range_bytes).cast("string"))).otherwise(""))
    return _scan_rows(rows, failed, target, rules)


def _scan_rows(rows: DataFrame, failed, target: str, rules: RuleSet | None) -> Scan:
    """Tagged rows from (file_path, content, kind, lines_before): only rows of kind ``finding`` are searched."""
    rules = rules or RuleSet.builtin()
    searched = F.col("kind") == "finding"
    texts = rows.select(
        "file_path", "kind", "lines_before", (~searched).alias("passing"), F.when(searched, decode_lenient(F.col("content"))).alias("text"),
        F.when(F.col("kind") == "error", "read").alias("stage"), F.when(F.col("kind") == "error", failed).alias("message"))
    found = attach_rules(find_hits(texts, "text", rules, passing="passing"), rules, "left")
    found = found.withColumn("source_id", F.col("file_path")).withColumn("line_number", (F.col("lines_before") + F.col("line_number")).cast("int"))
    return Scan.of_tagged(_tagged(found, target))


def _held(rows: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """The rows of these commits (repo, commit_sha)."""
    return rows.alias("p").join(
        commits.alias("r"), F.col(f"p.{repo}").eqNullSafe(F.col("r.repo")) & (F.col("p.commit_sha") == F.col("r.commit_sha")), "left_semi")


def scan_history(patches: DataFrame, rules: RuleSet | None = None, *, depth: int | None = None,
                 branch: str | None = None, heads: DataFrame | None = None, keep_plus_plus: bool = False,
                 partitions: int | None = None) -> Scan:
    """A scan of the lines that commits added. ``patches`` has the columns of ``PATCH_COLUMNS``, ``problem`` if it likes.

    With ``heads`` (repo, branch, commit_sha) and the column ``parent_shas``, only commits that the heads of ``branch``, or all
    heads, can reach are scanned, and ``depth`` counts these. Without heads ``branch`` filters a column ``branch``, if there is one.

    A secret found repeatedly in one file of one commit is reported once. Records and changes that
    could not be parsed are error rows.
    """
    rules = rules or RuleSet.builtin()
    held, searched = None, None
    if heads is not None:
        wanted = heads if branch is None else heads.where(F.col("branch") == branch)
        held = reachable_commits(patches.select("repo", "commit_sha", "parent_shas"), wanted)
        # No text is moved to find the held commits: a filter lets pass those to search, and their findings are joined. Of
        # what is joined here, the rest reads no text.
        searched = patches.where(may_hold(held, "repo", "commit_sha"))
        # Rows that could not be parsed belong to no branch.
        patches = _held(patches, held, "repo")
    elif branch is not None and "branch" in patches.columns:
        patches = patches.where(F.col("branch") == branch)
    errors = _no_errors(patches.sparkSession)
    if "problem" in patches.columns:
        errors = patches.where("problem IS NOT NULL").select(
            F.lit("history").alias("source_type"), F.col("repo").cast("string").alias("target"),
            F.col("commit_sha").alias("source_id"), F.lit("parse").alias("stage"), F.col("problem").alias("message"))
        patches = patches.where("commit_sha IS NOT NULL")
    if held is None:
        patches = searched = newest_commits(patches, depth)
    else:
        searched = newest_commits(searched, depth, patches)
        patches = newest_commits(patches, depth)
    if "patch_pos" not in searched.columns:
        searched = searched.withColumn("patch_pos", F.lit(0))
    diffs = searched.where(F.length("file_path") > 0).select(
        F.col("repo").alias("target"), "commit_sha",
        F.coalesce("author", F.lit("unknown")).alias("commit_author"),
        F.coalesce("committed_at", F.lit("")).alias("commit_date"),
        "file_path", "patch_pos", "patch")
    hits = find_hits(diffs, "patch", rules, added_lines_only=True, keep_plus_plus=keep_plus_plus, partitions=partitions)
    # Rules of one id are one rule here, by the number of the first of them.
    numbers: dict[str, int] = {}
    same = F.array(*[F.lit(numbers.setdefault(rule.rule_id, ord_)) for ord_, rule in rules.numbered()])
    hits = hits.withColumnRenamed("line_number", "line_pos").withColumn("rule", same[F.col("ord") - 1])
    first = first_occurrences(hits, key=("target", "file_path", "rule", "matched_text", "commit_sha"))
    if held is not None:
        first = _held(first, held, "target")
    findings = canonical(attach_rules(first.drop("rule"), rules), source_type=F.lit("history"), source_id=F.col("commit_sha"),
                         line_number=F.lit(0))
    commits = patches.select("repo", F.col("commit_sha").alias("source_id")).distinct()
    return Scan(findings, _log(commits, "history", F.col("repo")), errors)


def scan_payloads(payloads: DataFrame, rules: RuleSet | None = None, *, branch: str | None = None) -> Scan:
    """A scan of captured repository payloads; undecodable contents count as scanned and give nothing."""
    rules = rules or RuleSet.builtin()
    entries = decode_payloads(select_payloads(on_branch(payloads, branch)))
    texts = entries.select(F.col("repo").alias("target"), F.col("path").alias("file_path"), "text")
    found = attach_rules(find_hits(texts, "text", rules), rules)
    findings = canonical(found, source_type=F.lit("hosted"), source_id=F.col("file_path"))
    log = _log(entries.withColumnRenamed("path", "source_id"), "hosted", F.col("repo"))
    return Scan(findings, log, _no_errors(payloads.sparkSession))


def scan_trees(spark: SparkSession, paths: Iterable[str], rules: RuleSet | None = None,
               config: ScanConfig = ScanConfig()) -> Scan:
    """Scans of several targets, merged; a missing one becomes an error row."""
    first, *rest = [scan_tree(spark, path, rules, config) for path in paths]
    return first.merge(*rest) if rest else first
