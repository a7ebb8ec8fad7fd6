"""The registered queries, each with the SQL that gives the same rows in DuckDB where there is one."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from leaksieve.functions import labels, redact, text as texts
from leaksieve.functions.entropy import is_high_entropy, shannon_entropy
from leaksieve.functions.paths import file_name
from leaksieve.operators import files, order, rollup
from leaksieve.operators.ignore import is_ignored
from leaksieve.operators.merge import files_scanned
from leaksieve.operators.rule_index import RuleIndex, python_rule_rows, scan_with_index
from leaksieve.plans.copies import scan_copies
from leaksieve.plans.functions import register_functions
from leaksieve.plans.scan import attach_rules, find_hits, scan_text
from leaksieve.plans.sources import Scan, scan_history, scan_payloads, scan_table, scan_tree, scan_trees
from leaksieve.plans.views import register_views
from leaksieve.rules import Rule, RuleSet
from leaksieve.sources.patterns import rules_with_file
from leaksieve.sinks.documents import report_documents, sarif_documents, sarif_results, write_report_file, write_sarif_file
from leaksieve.sinks.joined import read_joined
from leaksieve.sinks.tables import json_findings, report_rows, write_table
from leaksieve.sources.patches import parse_commits, read_git_log
from leaksieve.sources.tree import select_files
from leaksieve.streaming.scans import drop_repeats, keep_first, scan_stream, write_findings
from workload.oracle import WHITESPACE_SQL, quote, rules_values, scan_ctes, scan_sql
from workload.scratch import scratch_dir
from workload.tables import duckdb_sql, input_partitions, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FOUND = ("line_number", "ord", "rule_id", "rule_name", "severity", "severity_rank", "snippet", "matched_text",
         "description")
FOUND_SQL = ", ".join(FOUND)


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function
    return register


# --- scans of text tables ------------------------------------------------------------------

@query(scan_sql("documents", ["doc_id"], f"SELECT doc_id, {FOUND_SQL} FROM found"))
def scan_documents(spark, sf_dir):
    return scan_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", partitions=input_partitions(spark))


@query(scan_sql("documents", ["doc_id"], "SELECT ord, rule_id, count(*) AS n FROM found GROUP BY ord, rule_id"))
def scan_documents_by_rule(spark, sf_dir):
    return rollup.by_rule(scan_documents(spark, sf_dir))


@query(scan_sql("documents", ["doc_id"], "SELECT severity, count(*) AS n FROM found GROUP BY severity"))
def scan_by_severity(spark, sf_dir):
    return rollup.by_severity(scan_documents(spark, sf_dir))


@query(scan_sql("documents", ["source", "lang"],
                "SELECT source, lang, count(*) AS n FROM found GROUP BY source, lang"))
def scan_by_file(spark, sf_dir):
    found = scan_text(table(spark, sf_dir, "documents").select("source", "lang", "text"), "text", partitions=input_partitions(spark))
    return rollup.by_file(found, "source", "lang")


@query(scan_sql(duckdb_sql("planted_conversations"), ["conv_id", "turn"],
                f"SELECT conv_id, turn, {FOUND_SQL} FROM found"))
def scan_conversations_planted(spark, sf_dir):
    return scan_text(table(spark, sf_dir, "planted_conversations").select("conv_id", "turn", "text"), "text")


@query(scan_sql(duckdb_sql("planted_documents"), ["doc_id"],
                "SELECT ord, rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs, min(matched_text) AS first_text, "
                "max(matched_text) AS last_text FROM found GROUP BY ord, rule_id"))
def planted_all_rules(spark, sf_dir):
    found = scan_text(table(spark, sf_dir, "planted_documents"), "text")
    # A document holds each rule's lines itself: counting per document first spreads the distinct count.
    per_doc = found.groupBy("ord", "rule_id", "doc_id").agg(
        F.count("*").alias("n"), F.min("matched_text").alias("low"), F.max("matched_text").alias("high"))
    return per_doc.groupBy("ord", "rule_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("docs"), F.min("low").alias("first_text"),
        F.max("high").alias("last_text"))


_SHARED = "concat(text, chr(10), 'pwd = ', chr(39), 'shared-', source, chr(39))"


@query(scan_sql(f"(SELECT doc_id, unnest(range(10)) AS copy, {_SHARED} AS text FROM documents)", ["doc_id", "copy"],
                "SELECT doc_id, CAST(copy AS INTEGER) AS copy, line_number, rule_id, matched_text FROM found"))
def copies_scan(spark, sf_dir):
    """Ten copies of every document with a secret: each distinct text is matched once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SHARED).alias("text"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy"))
    return scan_copies(docs, "text", partitions=input_partitions(spark)).select("doc_id", "copy", "line_number", "rule_id", "matched_text")


CUSTOM_PATTERNS = (
    ("Mail Address", r"[0-9a-z.]+@mail[0-9]\.example\.com"),
    ("Phone Number", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"),
    ("Dotted Quad", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("Line Start", r"^[A-Z][a-z]+\. [A-Z]"),
)


def custom_rules(spark: SparkSession | None = None) -> RuleSet:
    return RuleSet.builtin().with_custom(CUSTOM_PATTERNS, spark)


@query(scan_sql("documents", ["doc_id"], f"SELECT doc_id, {FOUND_SQL} FROM found",
                rules=RuleSet.builtin().with_custom(CUSTOM_PATTERNS)))
def custom_patterns(spark, sf_dir):
    return scan_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", custom_rules(spark),
                     partitions=input_partitions(spark))


_RULE_COUNTS = scan_sql(duckdb_sql("planted_conversations"), ["conv_id"],
                        "SELECT ord, count(*) AS n FROM found GROUP BY ord")


@query("SELECT rules.ord, rules.rule_id, rules.rule_name, upper(rules.severity) AS severity, "
       "CASE WHEN length(rules.description) > 50 THEN concat(left(rules.description, 50), '…') "
       "ELSE rules.description END AS description, coalesce(f.n, 0) AS n FROM " + rules_values(RuleSet.builtin())
       + f" LEFT JOIN ({_RULE_COUNTS}) f ON f.ord = rules.ord")
def rule_catalogue(spark, sf_dir):
    listing = rollup.rule_listing(RuleSet.builtin().to_frame(spark))
    counts = rollup.by_rule(scan_conversations_planted(spark, sf_dir)).select("ord", "n")
    return listing.join(counts, "ord", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT rules.severity, count(DISTINCT rules.ord) AS rules, CAST(sum(f.n) AS BIGINT) AS findings FROM "
       + rules_values(RuleSet.builtin()) + f" JOIN ({_RULE_COUNTS}) f ON f.ord = rules.ord GROUP BY rules.severity")
def rule_catalogue_summary(spark, sf_dir):
    counted = rollup.rule_counts(RuleSet.builtin().to_frame(spark)).withColumnRenamed("n", "rules")
    findings = rollup.by_severity(scan_conversations_planted(spark, sf_dir)).withColumnRenamed("n", "findings")
    return counted.join(findings, "severity")


# Rules a user registers under a category of their own: anchored, without regard to case, gated by a keyword.
REGISTERED = (
    Rule("own-line-start", "Line start", r"^[A-Z][a-z]+\. [A-Z]", "low", "A line that begins with a short sentence", category="mycorp"),
    Rule("own-mail", "Mail", r"(?i)MAIL[0-9]\.EXAMPLE\.COM", "medium", keywords=("@mail",), category="mycorp"),
    Rule("own-gated", "Gated phone", r"555-[0-9]{4}", "high", keywords=("example.com",), category="mycorp"),
    Rule("own-line-end", "Line end", r"[a-z]{9}\.$", "low", category="mycorp"),
)


@query(scan_sql("documents", ["doc_id"], f"SELECT doc_id, {FOUND_SQL} FROM found", rules=RuleSet.builtin().with_rules(*REGISTERED)))
def registered_rules(spark, sf_dir):
    rules = RuleSet.builtin().with_rules(*REGISTERED)
    return scan_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", rules, partitions=input_partitions(spark))


@query(scan_sql("documents", ["doc_id"], "SELECT doc_id, line_number, rule_id, matched_text FROM found WHERE ord > 78",
                rules=RuleSet.builtin().with_rules(*[
                    Rule(f"custom-custom-pattern-#{n}", f"Custom Pattern #{n}", p, "high")
                    for n, (_, p) in zip((2, 4, 5, 7), CUSTOM_PATTERNS)])))
def pattern_file_scan(spark, sf_dir):
    """Patterns read from a file with a comment and blank lines."""
    one, two, three, four = (pattern for _, pattern in CUSTOM_PATTERNS)
    folder = f"{scratch_dir(spark)}/patterns"
    lines = "\n".join(["# own patterns", one, "", f"  {two}  ", three, "# more", four])
    spark.range(1).select(F.lit(lines).alias("value")).write.text(folder)
    rules = rules_with_file(spark, folder)
    found = scan_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", rules, partitions=input_partitions(spark))
    return found.where("ord > 78").select("doc_id", "line_number", "rule_id", "matched_text")


_WORD_RULES = ("(SELECT CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS ord, word FROM (SELECT DISTINCT unnest("
               "regexp_extract_all(lower(text), '[a-z]{11,}')) AS word FROM documents))")


@query(f"WITH rules AS {_WORD_RULES}, pieces AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), "
       "raw_lines AS (SELECT doc_id, unnest(parts) AS line, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_number FROM pieces) "
       "SELECT doc_id, line_number, ord, concat('word-', word) AS rule_id, regexp_extract(line, concat(word, '[a-z]*,? [A-Za-z]'), 0) AS matched_text "
       f"FROM raw_lines JOIN rules ON contains(lower(line), word) WHERE length(trim(line, {WHITESPACE_SQL})) >= 8 "
       "AND regexp_matches(line, concat(word, '[a-z]*,? [A-Za-z]'))")
def indexed_rules_scan(spark, sf_dir):
    """A rule for every long word of the documents, thousands of them, found through the index of keywords."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{11,}"), F.lit(0))).alias("word")).distinct()
    rules = order.with_position(words.orderBy("word")).select(
        F.col("position").cast("int").alias("ord"), F.concat(F.lit("word-"), "word").alias("rule_id"),
        F.concat("word", F.lit("[a-z]*,? [A-Za-z]")).alias("pattern"), F.array("word").alias("keywords"))
    found = scan_with_index(docs.select("doc_id", "text"), "text", RuleIndex(python_rule_rows(rules)), partitions=input_partitions(spark))
    return found.select("doc_id", "line_number", "ord", "rule_id", "matched_text")


@query(f"SELECT file_path, count(*) AS n FROM (SELECT concat_ws('/', role, conv_id, turn) AS file_path FROM ("
       + scan_sql(duckdb_sql("planted_conversations"), ["role", "conv_id", "turn"], "SELECT role, conv_id, turn FROM found")
       + ")) GROUP BY file_path")
def findings_by_path(spark, sf_dir):
    return rollup.by_file(_planted_findings(spark, sf_dir))


# --- text handling -------------------------------------------------------------------------

@query("WITH parts AS (SELECT doc_id, regexp_split_to_array(text, " + quote(
           r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]") + ") AS p FROM " + duckdb_sql("odd_lines") + "), "
       "lines AS (SELECT doc_id, unnest(p) AS line, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS line_number FROM parts) "
       f"SELECT doc_id, line_number, length(line) AS n_chars, trim(line, {WHITESPACE_SQL}) AS snippet FROM lines "
       f"WHERE length(trim(line, {WHITESPACE_SQL})) >= 8")
def line_split(spark, sf_dir):
    lines = table(spark, sf_dir, "odd_lines").select("doc_id", F.posexplode(texts.split_lines(F.col("text"))).alias("pos", "line"))
    return lines.where(texts.long_enough(F.col("line"))).select(
        "doc_id", (F.col("pos") + 1).alias("line_number"), F.length("line").cast("long").alias("n_chars"),
        texts.strip(F.col("line")).alias("snippet"))


@query("SELECT doc_id, md5(concat(text, ' tail')) AS digest, doc_id % 2 = 1 AS was_malformed FROM documents")
def decode_malformed(spark, sf_dir):
    """Documents of odd ids get two invalid bytes, the others are valid."""
    raw = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 2 == 1, F.lit(b"\xff\xc3")).otherwise(F.lit(b"")), F.lit(b" tail"))
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", F.md5(texts.decode_lenient(F.col("raw"))).alias("digest"),
                       texts.decode_strict(F.col("raw")).isNull().alias("was_malformed"))


# --- file filters --------------------------------------------------------------------------

IGNORE = ("# generated and test files", "docs/", "!docs/keep/", "**/generated/", "*.test.js", "/src/Doc1*", "note?.md")

_NAME = "regexp_extract(rel_path, '([^/]*)$', 1)"
_NAME_SQL = (
    "(" + " OR ".join(f"contains(lower({_NAME}), {quote(w)})" for w in files.SENSITIVE_NAMES)
    + f" OR regexp_extract(lower({_NAME}), '^.+(\\.[^.]+)$', 1) IN (" + ", ".join(quote(e) for e in files.EXTENSIONS)
    + f") OR lower({_NAME}) IN (" + ", ".join(quote(w) for w in files.WELL_KNOWN_NAMES) + "))")
_DIRS_SQL = "(" + " OR ".join(f"contains('/' || rel_path, {quote('/' + d + '/')})" for d in files.EXCLUDED_DIRS) + ")"
_IGNORED_SQL = (
    r"CASE WHEN regexp_matches(rel_path, '(^|/)note[^/]\.md$') THEN true "
    r"WHEN regexp_matches(rel_path, '^src/Doc1[^/]*$') THEN true "
    r"WHEN regexp_matches(rel_path, '\.test\.js$') THEN true WHEN contains('/' || rel_path, '/generated/') THEN true "
    r"WHEN contains('/' || rel_path, '/docs/keep/') THEN false WHEN contains('/' || rel_path, '/docs/') THEN true "
    r"ELSE false END")


@query(f"SELECT doc_id, rel_path, {_DIRS_SQL} AS excluded, {_NAME_SQL} AS name_included, "
       f"strlen(text) BETWEEN 1 AND 20000 AS size_ok FROM {duckdb_sql('source_files')}")
def file_manifest_filter(spark, sf_dir):
    path = F.col("rel_path")
    return table(spark, sf_dir, "source_files").select(
        "doc_id", "rel_path", (~files.outside_excluded_dirs(path)).alias("excluded"),
        files.scannable_name(file_name(path)).alias("name_included"),
        files.size_in_bounds(F.octet_length("text"), 20000).alias("size_ok"))


@query(f"SELECT doc_id, rel_path, {_IGNORED_SQL} AS ignored FROM {duckdb_sql('source_files')}")
def ignore_filter(spark, sf_dir):
    return table(spark, sf_dir, "source_files").select(
        "doc_id", "rel_path", is_ignored(F.col("rel_path"), IGNORE).alias("ignored"))


@query("SELECT doc_id, lang = 'de' AND strlen(text) < 8192 AS is_binary, strlen(text) + 1 AS length FROM documents")
def binary_and_size_filter(spark, sf_dir):
    """German documents get a null byte at the end: only within the sniffed bytes it marks them binary."""
    raw = F.concat(F.encode("text", "UTF-8"), F.when(F.col("lang") == "de", F.lit(b"\x00")).otherwise(F.lit(b"\n")))
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("content"))
    return docs.select("doc_id", files.is_binary(F.col("content")).alias("is_binary"),
                       F.octet_length("content").cast("long").alias("length"))


@query(scan_sql(f"(SELECT * FROM {duckdb_sql('source_files')} WHERE NOT {_DIRS_SQL} AND {_NAME_SQL} AND NOT ({_IGNORED_SQL}))",
                ["doc_id", "rel_path"], "SELECT doc_id, rel_path, line_number, rule_id, matched_text FROM found"))
def selected_files_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "source_files")
    listing = rows.select(
        "doc_id", "rel_path", file_name(F.col("rel_path")).alias("name"), F.octet_length("text").alias("length"),
        F.lit(False).alias("single"), "text")
    chosen = select_files(listing, IGNORE).select("doc_id", "rel_path", "text")
    return scan_text(chosen, "text").select("doc_id", "rel_path", "line_number", "rule_id", "matched_text")


_TREE_SQL = (f"(SELECT rel_path AS file_path, text FROM {duckdb_sql('tree_files')} WHERE NOT has_null AND NOT {_DIRS_SQL} "
             f"AND {_NAME_SQL} AND NOT ({_IGNORED_SQL}) AND strlen(text) <= 2097152)")


def _write_files(root: str):
    """Writes rows as files below a shared folder; returns how many. A repeated task writes the same files."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path = os.path.join(root, row["rel_path"])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as file:
                    file.write((b"\x00" if row["has_null"] else b"") + row["text"].encode("utf-8"))
            yield pa.record_batch({"n": [batch.num_rows]})
    return run


@query(scan_sql(_TREE_SQL, ["file_path"], "SELECT file_path, line_number, rule_id, matched_text FROM found"))
def tree_scan(spark, sf_dir):
    """The documents written out as files below the shared folder, and scanned as a source tree."""
    root = f"{scratch_dir(spark).removeprefix('file://')}/tree"
    rows = table(spark, sf_dir, "tree_files").select("rel_path", "has_null", "text")
    rows.mapInArrow(_write_files(root), "n long").agg(F.sum("n")).collect()
    # Patterns count from the end: the ignore file's come first, and the last one that matches decides.
    with open(os.path.join(root, ".gitignore"), "w") as file:
        file.write("\n".join(IGNORE[:4]))
    scan = scan_tree(spark, root, config=files.ScanConfig(ignore_patterns=IGNORE[4:]))
    return scan.findings.select("file_path", "line_number", "rule_id", "matched_text")


_ONE_FILE = "(SELECT 1 AS id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents)"
_BENCH_FILES = "(SELECT item_id, concat(text, chr(10), 'pwd = ', chr(39), 'bench-', cast(item_id AS string), chr(39)) AS text FROM benchmark)"


@query("SELECT * FROM (" + scan_sql(_ONE_FILE, ["id"], "SELECT 'file' AS target, line_number, rule_id, matched_text, CAST(NULL AS VARCHAR) "
                                    "AS message FROM found")
       + ") UNION ALL SELECT * FROM (" + scan_sql(_BENCH_FILES, ["item_id"], "SELECT 'tree', CAST(NULL AS INTEGER), rule_id, matched_text, "
                                                  "CAST(NULL AS VARCHAR) FROM found")
       + ") UNION ALL SELECT 'missing', NULL, NULL, NULL, 'Path not found: missing'")
def file_and_targets_scan(spark, sf_dir):
    """All documents in one file, read in ranges by many tasks; a tree; and a target that does not exist."""
    folder = scratch_dir(spark).removeprefix("file://")
    table(spark, sf_dir, "documents").orderBy("doc_id").select("text").write.text(f"{folder}/parts")
    with open(f"{folder}/all.txt", "wb") as whole:
        for name in sorted(n for n in os.listdir(f"{folder}/parts") if n.startswith("part-")):
            with open(f"{folder}/parts/{name}", "rb") as part:
                shutil.copyfileobj(part, whole)
    secret = F.concat("text", F.lit("\npwd = 'bench-"), "item_id", F.lit("'"))
    table(spark, sf_dir, "benchmark").select(secret).write.text(f"{folder}/tree")
    targets = {f"{folder}/all.txt": "file", f"{folder}/tree": "tree", f"{folder}/missing": "missing"}
    scan = scan_trees(spark, list(targets), config=files.ScanConfig(range_bytes=1 << 18)).written(f"{folder}/scan")
    named = F.create_map(*[F.lit(v) for pair in targets.items() for v in pair])[F.col("target")]
    found = scan.findings.select(
        named.alias("target"), F.when(named == "file", F.col("line_number")).alias("line_number"), "rule_id", "matched_text")
    errors = scan.errors.select(named.alias("target"), F.replace("message", F.lit(f"{folder}/")).alias("message"))
    return found.unionByName(errors, allowMissingColumns=True)


# --- hosted repositories -------------------------------------------------------------------

_HOSTED_SQL = (
    "(" + " OR ".join(f"ends_with(lower(name), {quote(e)})" for e in files.HOSTED_EXTENSIONS) + " OR "
    + " OR ".join(f"contains(lower(name), {quote(w)})" for w in files.HOSTED_SENSITIVE_NAMES) + ")")


def _payloads(spark, sf_dir):
    """Pages as captured payloads; some are of another branch, directories, or below an excluded directory."""
    wrapped = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), "(.{76})", "$1\n")
    page = F.col("page_id")
    return table(spark, sf_dir, "site_files").select(
        "repo", F.lit("trunk").alias("default_branch"), F.when(page % 3 == 0, "dev").otherwise("trunk").alias("ref"),
        F.when(page % 5 == 0, "dir").otherwise("file").alias("type"),
        F.concat(F.when(page % 7 == 0, "web/dist/").otherwise(""), "rel_path").alias("path"), "name",
        wrapped.alias("content_b64"))


@query(scan_sql(f"(SELECT repo, rel_path, html AS text FROM {duckdb_sql('site_files')} WHERE {_HOSTED_SQL} "
                "AND page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0)",
                ["repo", "rel_path"],
                "SELECT repo AS target, rel_path AS file_path, line_number, rule_id, snippet, matched_text FROM found"))
def api_manifest_scan(spark, sf_dir):
    found = scan_payloads(_payloads(spark, sf_dir)).findings
    return found.select("target", "file_path", "line_number", "rule_id", "snippet", "matched_text")


# --- commit history ------------------------------------------------------------------------

_PATCHES = f"(SELECT *, patch AS text FROM {duckdb_sql('patches')} WHERE file_path IS NOT NULL)"
_PATCH_IDS = ["repo", "commit_sha", "author", "committed_at", "file_path", "seq"]
_HISTORY_COLUMNS = ("target", "commit_sha", "commit_author", "commit_date", "file_path", "line_number", "rule_id",
                    "snippet", "matched_text")
_HISTORY_SELECT = (
    "SELECT repo AS target, commit_sha, coalesce(author, 'unknown') AS commit_author, committed_at AS commit_date, "
    "file_path, CAST(0 AS INTEGER) AS line_number, rule_id, snippet, matched_text FROM found "
    "QUALIFY row_number() OVER (PARTITION BY repo, file_path, rule_id, matched_text, commit_sha ORDER BY line_number) = 1")


@query(scan_sql(_PATCHES, ["commit_sha", "file_path"],
                "SELECT commit_sha, file_path, line_number, rule_id, snippet, matched_text FROM found", added=True))
def history_added_lines(spark, sf_dir):
    rules = RuleSet.builtin()
    diffs = table(spark, sf_dir, "patches").where(F.length("file_path") > 0).select("commit_sha", "file_path", "patch")
    hits = attach_rules(find_hits(diffs, "patch", rules, added_lines_only=True), rules)
    return hits.select("commit_sha", "file_path", "line_number", "rule_id", "snippet", "matched_text")


@query(scan_sql(_PATCHES, _PATCH_IDS, _HISTORY_SELECT, added=True))
def history_dedup(spark, sf_dir):
    return scan_history(table(spark, sf_dir, "patches")).findings.select(*_HISTORY_COLUMNS)


_NEWEST = (f"(SELECT * FROM {_PATCHES} WHERE (repo, seq) IN (SELECT (repo, seq) FROM (SELECT DISTINCT repo, seq FROM "
           f"{duckdb_sql('patches')}) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY seq) <= 7))")


@query(scan_sql(_NEWEST, _PATCH_IDS, _HISTORY_SELECT, added=True))
def history_depth(spark, sf_dir):
    return scan_history(table(spark, sf_dir, "patches"), depth=7).findings.select(*_HISTORY_COLUMNS)


_EDGES = ("(SELECT repo, commit_sha, rn, unnest([first_sha, merged_sha]) AS parent FROM " + duckdb_sql("branched_patches") + ")")


@query("WITH RECURSIVE reach AS (SELECT repo, commit_sha FROM " + duckdb_sql("branched_patches") + " WHERE rn = 1 "
       f"UNION SELECT e.repo, e.parent FROM reach r JOIN {_EDGES} e ON e.repo = r.repo AND e.commit_sha = r.commit_sha WHERE e.parent IS NOT NULL), "
       + scan_ctes(_PATCHES, _PATCH_IDS, added=True)
       + f" SELECT * FROM ({_HISTORY_SELECT}) WHERE (target, commit_sha) IN (SELECT (repo, commit_sha) FROM reach)")
def branch_scan(spark, sf_dir):
    """The commits that the newest one of each repository reaches, by first parents and merges."""
    rows = table(spark, sf_dir, "branched_patches")
    heads = rows.where("rn IN (1, 10)").select("repo", F.when(F.col("rn") == 1, "main").otherwise("topic").alias("branch"), "commit_sha")
    patches = rows.withColumn("parent_shas", F.array_compact(F.array("first_sha", "merged_sha"))).drop("rn", "first_sha", "merged_sha")
    return scan_history(patches, branch="main", heads=heads).findings.select(*_HISTORY_COLUMNS)


_LOGGED = ("(SELECT doc_id, source, lang, concat('+', replace(text, chr(10), concat(chr(10), '+')), chr(10), "
           "'+pwd = ', chr(39), 'pass-', cast(doc_id AS string), chr(39)) AS text FROM documents)")


@query(scan_sql(_LOGGED, ["doc_id", "source", "lang"],
                "SELECT source AS target, md5(cast(doc_id AS string)) AS commit_sha, concat('dev-', lang) AS commit_author, "
                "'2024-01-02T00:00:00+00:00' AS commit_date, concat(lang, '.txt') AS file_path, rule_id, snippet, "
                "matched_text FROM found QUALIFY row_number() OVER "
                "(PARTITION BY doc_id, rule_id, matched_text ORDER BY line_number) = 1", added=True))
def git_log_scan(spark, sf_dir):
    records = table(spark, sf_dir, "log_records").select(
        "repo", F.lit(0).cast("long").alias("__block"), F.col("doc_id").alias("__row"), "value")
    found = scan_history(parse_commits(records)).findings
    return found.select("target", "commit_sha", "commit_author", "commit_date", "file_path", "rule_id", "snippet",
                        "matched_text")


@query(scan_sql(_LOGGED, ["doc_id", "source", "lang"],
                "SELECT md5(cast(doc_id AS string)) AS commit_sha, concat('dev-', lang) AS commit_author, "
                "concat(lang, '.txt') AS file_path, rule_id, snippet, matched_text FROM found QUALIFY row_number() OVER "
                "(PARTITION BY doc_id, rule_id, matched_text ORDER BY line_number) = 1", added=True))
def git_log_file_scan(spark, sf_dir):
    """The same commits, written as a log export and read back."""
    folder = f"{scratch_dir(spark)}/log"
    table(spark, sf_dir, "log_records").select(F.concat(F.lit("commit "), "value").alias("value")).write.text(folder)
    found = scan_history(read_git_log(spark, folder, "all")).findings
    return found.select("commit_sha", "commit_author", "file_path", "rule_id", "snippet", "matched_text")


@query("SELECT source AS target, CASE WHEN doc_id % 10 = 1 THEN md5(cast(doc_id AS string)) END AS source_id, 'parse' AS stage, "
       "CASE WHEN doc_id % 10 = 1 THEN 'Cannot parse change: diff --cc both.py' ELSE 'Cannot parse record' END AS message "
       "FROM documents WHERE doc_id % 10 < 2")
def history_errors(spark, sf_dir):
    """Log records of which some have no commit id and some a combined diff."""
    value, doc = F.col("value"), F.col("doc_id")
    broken = F.when(doc % 10 == 0, F.concat(F.lit("? "), value)).when(
        doc % 10 == 1, F.concat(value, F.lit("\ndiff --cc both.py\n@@@ -1 -1 +1 @@@\n++pwd = 'combined12'"))).otherwise(value)
    records = table(spark, sf_dir, "log_records").select(
        "repo", F.lit(0).cast("long").alias("__block"), doc.alias("__row"), broken.alias("value"))
    return scan_history(parse_commits(records)).errors.select("target", "source_id", "stage", "message")


# --- merged scans --------------------------------------------------------------------------

def _merged(spark, sf_dir) -> Scan:
    documents = scan_table(table(spark, sf_dir, "documents"), "text", "doc_id", "documents", partitions=input_partitions(spark))
    conversations = scan_table(
        table(spark, sf_dir, "planted_conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn")),
        "text", "id", "conversations")
    pages = scan_table(table(spark, sf_dir, "pages"), "html", "url", "pages", partitions=input_partitions(spark))
    questions = scan_table(table(spark, sf_dir, "benchmark"), "text", "item_id", "benchmark")
    return documents.merge(conversations, pages, questions, scan_history(table(spark, sf_dir, "patches")))


_MERGED_SQL = " UNION ALL ".join([
    "(" + scan_sql("documents", ["doc_id"], "SELECT 'table' AS source_type, 'documents' AS target, rule_id FROM found") + ")",
    "(" + scan_sql(duckdb_sql("planted_conversations"), ["conv_id"],
                   "SELECT 'table', 'conversations', rule_id FROM found") + ")",
    "(" + scan_sql("(SELECT html AS text, page_id FROM pages)", ["page_id"], "SELECT 'table', 'pages', rule_id FROM found") + ")",
    "(" + scan_sql("benchmark", ["item_id"], "SELECT 'table', 'benchmark', rule_id FROM found") + ")",
    "(" + scan_sql(_PATCHES, _PATCH_IDS, f"SELECT 'history', target, rule_id FROM ({_HISTORY_SELECT})", added=True) + ")",
])


@query(f"SELECT source_type, target, rule_id, count(*) AS n FROM ({_MERGED_SQL}) GROUP BY source_type, target, rule_id")
def merge_results(spark, sf_dir):
    findings = _merged(spark, sf_dir).findings
    return findings.groupBy("source_type", "target", "rule_id").agg(F.count("*").alias("n"))


@query("SELECT 'table' AS source_type, (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) "
       "+ (SELECT count(*) FROM pages) + (SELECT count(*) FROM benchmark) AS files_scanned UNION ALL "
       "SELECT 'history', count(*) FROM documents")
def scan_log_counts(spark, sf_dir):
    return files_scanned(_merged(spark, sf_dir).scan_log)


# --- reports -------------------------------------------------------------------------------

def _planted_findings(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "planted_conversations").select(
        F.concat_ws("/", "role", "conv_id", "turn").alias("id"), "text")
    return scan_table(rows, "text", "id", "conversations").findings


_PLANTED = (f"(SELECT concat_ws('/', role, conv_id, turn) AS file_path, text FROM {duckdb_sql('planted_conversations')})")
_PLANTED_CTES = scan_ctes(_PLANTED, ["file_path"])


def _redact_sql(text: str, ellipsis: str = "") -> str:
    return (f"CASE WHEN length({text}) <= 6 THEN concat(left({text}, 2), repeat('*', greatest(length({text}) - 2, 0))) "
            f"ELSE concat(left({text}, 6), repeat('*', least(length({text}) - 6, 20)), '{ellipsis}') END")


def _planted(select: str, more: str = "") -> str:
    return f"WITH {_PLANTED_CTES}{more} {select}"


# One group per line: its masked form, and its findings, which are unnested again.
_MASKED = (
    ", masked AS (SELECT file_path, line_number, list_reduce(list_transform(list_sort(list(DISTINCT "
    "{'o': -length(matched_text), 't': matched_text})), lambda m: m.t), "
    f"lambda acc, m: replace(acc, m, {_redact_sql('m', '…')}), any_value(line)) AS line_masked, "
    "list({'rule_id': rule_id, 'rule_name': rule_name, 'severity': severity, 'matched_text': matched_text, "
    "'description': description}) AS fs FROM found GROUP BY file_path, line_number)"
    ", each AS (SELECT file_path, line_number, line_masked, unnest(fs) AS f FROM masked)")


@query(_planted(
    f"SELECT file_path, line_number, f.rule_id AS detector_id, f.rule_name AS detector_name, f.severity AS severity, "
    f"trim(line_masked, {WHITESPACE_SQL}) AS snippet, {_redact_sql('f.matched_text')} AS matched_text, "
    "CAST(NULL AS VARCHAR) AS commit_sha, CAST(NULL AS VARCHAR) AS commit_author, CAST(NULL AS VARCHAR) AS commit_date, "
    "f.description AS description FROM each", _MASKED))
def redact_findings(spark, sf_dir):
    return json_findings(_planted_findings(spark, sf_dir))


_FIRST_MASKED = ("concat(left(snippet, position(matched_text IN snippet) - 1), " + _redact_sql("matched_text", "…")
                 + ", substr(snippet, position(matched_text IN snippet) + length(matched_text)))")


@query(_planted(f"SELECT file_path, line_number, ord, {_FIRST_MASKED} AS masked FROM found"))
def redact_snippet(spark, sf_dir):
    return _planted_findings(spark, sf_dir).select(
        "file_path", "line_number", "ord",
        redact.redact_snippet(F.col("snippet"), F.col("matched_text")).alias("masked"))


@query(_planted(
    "SELECT 'conversations' AS target, file_path, line_number, ord, upper(severity) AS badge, rule_name, "
    f"concat('Line ', line_number) AS label, {_FIRST_MASKED} AS snippet, description, "
    "row_number() OVER (ORDER BY file_path, line_number, ord) AS position FROM found"))
def report_order(spark, sf_dir):
    return order.with_position(report_rows(_planted_findings(spark, sf_dir)))


@query(_planted(
    "SELECT file_path, line_number, ord, severity_rank, concat(file_path, ':', line_number) AS location, "
    "row_number() OVER (ORDER BY severity_rank DESC, file_path, line_number, ord) AS position FROM found"))
def severity_order(spark, sf_dir):
    place = labels.location(F.col("file_path"), F.col("line_number"), F.col("commit_sha"))
    return order.with_position(order.severity_order(_planted_findings(spark, sf_dir)).select(
        "file_path", "line_number", "ord", labels.severity_rank(F.col("severity")).alias("severity_rank"),
        place.alias("location")))


@query(scan_sql(_PATCHES, _PATCH_IDS,
                "SELECT file_path, rule_id, concat(left(commit_sha, 8), ' → ', file_path, ':0') AS location, "
                "concat('(diff)', '  commit ', left(commit_sha, 8), ' by ', commit_author) AS label "
                f"FROM ({_HISTORY_SELECT})", added=True))
def history_labels(spark, sf_dir):
    found = scan_history(table(spark, sf_dir, "patches")).findings
    line, sha = F.col("line_number"), F.col("commit_sha")
    return found.select("file_path", "rule_id", labels.location(F.col("file_path"), line, sha).alias("location"),
                        labels.line_label(line, sha, F.col("commit_author")).alias("label"))


_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'low' THEN 'note' ELSE 'warning' END"
_SCORE = "CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '7.5' WHEN 'low' THEN '2.5' ELSE '5.0' END"


@query(_planted(
    "SELECT 'conversations' AS target, file_path, line_number, ord, to_json({'ruleId': rule_id, 'level': "
    + _LEVEL + ", 'message': {'text': concat('Potential secret detected: ', rule_name, '. ', description)}, "
    "'locations': [{'physicalLocation': {'artifactLocation': {'uri': file_path}, 'region': {'startLine': line_number, "
    "'snippet': {'text': snippet}}}}]})::VARCHAR AS result FROM found"))
def sarif_results_rows(spark, sf_dir):
    return sarif_results(_planted_findings(spark, sf_dir))


def _written_findings(spark, sf_dir) -> DataFrame:
    return write_table(_planted_findings(spark, sf_dir), f"{scratch_dir(spark)}/findings")


@query(_planted(f"SELECT rule_id, {_LEVEL} AS level, count(*) AS n, min(file_path) AS first_uri, "
                "CAST(min(line_number) AS BIGINT) AS first_line FROM found GROUP BY rule_id, level"))
def sarif_document_contents(spark, sf_dir):
    """SARIF documents of the findings, parsed again and counted."""
    documents = sarif_documents(_written_findings(spark, sf_dir))
    results = documents.select(F.explode(F.from_json("value", "runs array<struct<results: array<struct<ruleId: string, "
        "level: string, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, "
        "region: struct<startLine: bigint>>>>>>>>")["runs"][0]["results"]).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return results.groupBy(F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level")).agg(
        F.count("*").alias("n"), F.min(place["artifactLocation"]["uri"]).alias("first_uri"),
        F.min(place["region"]["startLine"]).alias("first_line"))


@query(_planted("SELECT severity, count(*) AS n, (SELECT count(*) FROM found) AS total, "
                "(SELECT count(*) FROM conversations) AS files_scanned FROM found GROUP BY severity"))
def json_report_contents(spark, sf_dir):
    """JSON reports of the findings, parsed again and counted."""
    findings = _written_findings(spark, sf_dir)
    log = table(spark, sf_dir, "conversations").select("conv_id")
    documents = report_documents(findings, log, target="conversations", scan_type="table")
    parsed = documents.select(F.from_json("value", "scan struct<files_scanned: bigint>, summary "
        "struct<total_findings: bigint>, findings array<struct<severity: string>>").alias("d"))
    rows = parsed.select("d.scan.files_scanned", F.col("d.summary.total_findings").alias("total"),
                         F.explode("d.findings.severity").alias("severity"))
    return rows.groupBy("severity", "total", "files_scanned").agg(F.count("*").alias("n"))


def _mixed_findings(spark, sf_dir) -> DataFrame:
    """Planted findings, some without a line and some of a commit, written."""
    found = _planted_findings(spark, sf_dir).withColumns({
        "line_number": F.when(F.col("ord") % 2 == 0, 0).otherwise(F.col("line_number")).cast("int"),
        "commit_sha": F.when(F.col("ord") % 3 == 0, F.md5("file_path")), "commit_author": F.when(F.col("ord") % 6 == 0, "dev")})
    return write_table(found, f"{scratch_dir(spark)}/findings")


def _unreadable(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Cannot read \""), "item_id", F.lit("\"")).alias("message"))


def _parsed(spark, path: str, schema: str, **members: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What the file ``path`` says, parsed in full: a row of its one document without arrays' entries, and the entries ``e`` of each array."""
    frame, entries = read_joined(spark, path)
    document = spark.range(1).select(F.from_json(F.lit(frame), schema).alias("d"))
    # Texts are no JSON documents by themselves.
    return document, {name: entries.where(F.col("member") == name).select(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{kind}>")[0].alias("e"))
                      for name, kind in members.items()}


_MIXED = (_MASKED.replace("{'rule_id'", "{'ord': ord, 'rule_id'")
          + ", mixed AS (SELECT f.ord AS ord, f.rule_id AS rule_id, f.rule_name AS rule_name, f.severity AS severity, "
          "f.description AS description, f.matched_text AS matched_text, file_path, "
          "CASE WHEN f.ord % 2 = 0 THEN 0 ELSE line_number END AS line_number, "
          f"trim(line_masked, {WHITESPACE_SQL}) AS masked, CASE WHEN f.ord % 3 = 0 THEN md5(file_path) END AS commit_sha, "
          "CASE WHEN f.ord % 6 = 0 THEN 'dev' END AS commit_author FROM each)")


@query(_planted(
    f"SELECT 'result' AS kind, rule_id AS id, {_LEVEL} AS level, concat('Potential secret detected: ', rule_name, '. ', description) AS text, "
    "file_path AS uri, CAST(CASE WHEN line_number > 0 THEN line_number END AS BIGINT) AS line, CASE WHEN line_number > 0 THEN masked END AS snippet, "
    "commit_sha, CASE WHEN commit_sha IS NOT NULL THEN coalesce(commit_author, '') END AS commit_author FROM mixed "
    f"UNION ALL SELECT 'rule', rule_id, any_value({_LEVEL}), any_value(description), any_value(rule_name), NULL, any_value({_SCORE}), NULL, NULL "
    "FROM mixed GROUP BY rule_id UNION ALL SELECT 'note', NULL, 'error', concat('Cannot read \"', item_id, '\"'), NULL, NULL, 'false', NULL, NULL FROM benchmark",
    _MIXED))
def sarif_file(spark, sf_dir):
    """One SARIF document of a scan with errors, of findings without a line and of commits; parsed again in full."""
    path = f"{scratch_dir(spark)}/scan.sarif"
    write_sarif_file(_mixed_findings(spark, sf_dir), path, _unreadable(spark, sf_dir))
    document, found = _parsed(
        spark, path, "runs array<struct<invocations: array<struct<executionSuccessful: boolean>>>>",
        rules="struct<id: string, name: string, fullDescription: struct<text: string>, defaultConfiguration: struct<level: string>, "
              "properties: struct<`security-severity`: string>>",
        results="struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<"
                "artifactLocation: struct<uri: string>, region: struct<startLine: bigint, snippet: struct<text: string>>>>>, "
                "properties: struct<commit_sha: string, commit_author: string, commit_date: string>>",
        toolExecutionNotifications="struct<message: struct<text: string>, level: string>")
    none = F.lit(None).cast("string")
    place = F.col("r.locations")[0]["physicalLocation"]
    results = found["results"].select(F.col("e").alias("r")).select(
        F.lit("result").alias("kind"), F.col("r.ruleId").alias("id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("text"),
        place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"), place["region"]["snippet"]["text"].alias("snippet"),
        F.col("r.properties.commit_sha").alias("commit_sha"), F.col("r.properties.commit_author").alias("commit_author"))
    rules = found["rules"].select(F.col("e").alias("r")).select(
        F.lit("rule").alias("kind"), "r.id", F.col("r.defaultConfiguration.level").alias("level"), F.col("r.fullDescription.text").alias("text"),
        F.col("r.name").alias("uri"), F.lit(None).cast("long").alias("line"), F.col("r.properties")["security-severity"].alias("snippet"),
        none.alias("commit_sha"), none.alias("commit_author"))
    clean = F.broadcast(document.select(F.col("d.runs")[0]["invocations"][0]["executionSuccessful"].cast("string").alias("clean")))
    notes = found["toolExecutionNotifications"].crossJoin(clean).select(F.col("e").alias("n"), "clean").select(
        F.lit("note").alias("kind"), none.alias("id"), F.col("n.level").alias("level"), F.col("n.message.text").alias("text"), none.alias("uri"),
        F.lit(None).cast("long").alias("line"), F.col("clean").alias("snippet"), none.alias("commit_sha"), none.alias("commit_author"))
    return results.unionByName(rules).unionByName(notes)


@query(_planted(
    "SELECT file_path, CAST(line_number AS BIGINT) AS line_number, rule_id AS detector_id, rule_name AS detector_name, severity, masked AS snippet, "
    f"{_redact_sql('matched_text')} AS matched_text, commit_sha, commit_author, description, CAST(NULL AS VARCHAR) AS error, "
    "(SELECT count(*) FROM found) AS total, (SELECT count(*) FROM found WHERE severity = 'critical') AS critical, "
    "(SELECT count(*) FROM conversations) AS files_scanned FROM mixed UNION ALL "
    "SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, concat('Cannot read \"', item_id, '\"'), (SELECT count(*) FROM found), "
    "(SELECT count(*) FROM found WHERE severity = 'critical'), (SELECT count(*) FROM conversations) FROM benchmark", _MIXED))
def json_report_file(spark, sf_dir):
    """One JSON report of the same scan, parsed again in full."""
    path = f"{scratch_dir(spark)}/report.json"
    log = table(spark, sf_dir, "conversations").select("conv_id")
    write_report_file(_mixed_findings(spark, sf_dir), log, path, _unreadable(spark, sf_dir), target="conversations", scan_type="table")
    fields = ("file_path", "line_number", "detector_id", "detector_name", "severity", "snippet", "matched_text", "commit_sha", "commit_author", "description")
    document, found = _parsed(
        spark, path, "scan struct<files_scanned: bigint>, summary struct<total_findings: bigint, critical: bigint>", errors="string",
        findings="struct<" + ", ".join(f"{f}: {'bigint' if f == 'line_number' else 'string'}" for f in fields) + ">")
    counts = F.broadcast(document.select(
        F.col("d.summary.total_findings").alias("total"), F.col("d.summary.critical").alias("critical"), F.col("d.scan.files_scanned").alias("files_scanned")))
    rows = found["findings"].select("e.*").crossJoin(counts)
    return rows.unionByName(found["errors"].select(F.col("e").alias("error")).crossJoin(counts), allowMissingColumns=True)


@query(scan_sql(duckdb_sql("planted_conversations"), ["role"],
                "SELECT role, rules.category, count(*) AS n FROM found JOIN (VALUES "
                + ", ".join(f"({i}, {quote(r.category)})" for i, r in RuleSet.builtin().numbered())
                + ") AS rules(ord, category) ON rules.ord = found.ord GROUP BY role, rules.category"))
def sql_views(spark, sf_dir):
    """Rules and findings joined in SQL."""
    rows = table(spark, sf_dir, "planted_conversations").select("role", "text")
    register_views(scan_text(rows, "text"))
    return spark.sql("SELECT role, category, count(*) AS n FROM findings JOIN rules ON rules.ord = findings.ord "
                     "GROUP BY role, category")


@query(scan_sql(duckdb_sql("planted_conversations"), ["conv_id", "turn"],
                "SELECT conv_id, turn, line_number, rule_id, snippet, matched_text FROM found WHERE severity = 'critical'"))
def table_function_scan(spark, sf_dir):
    """The table function over a query's rows."""
    table(spark, sf_dir, "planted_conversations").createOrReplaceTempView("planted_conversations")
    register_functions(spark)
    return spark.sql("SELECT conv_id, turn, line_number, rule_id, snippet, matched_text "
                     "FROM scan_text(TABLE(SELECT conv_id, turn, text FROM planted_conversations), 'text') WHERE severity = 'critical'")


@query(_planted(
    f"SELECT rule_id, any_value(rule_name) AS rule_name, any_value(severity) AS severity, any_value(description) AS "
    f"full_description, any_value({_LEVEL}) AS level, any_value({_SCORE}) AS security_severity, min(file_path) AS first_file "
    "FROM found GROUP BY rule_id"))
def sarif_rules(spark, sf_dir):
    used = rollup.rules_used(_planted_findings(spark, sf_dir))
    return used.select("rule_id", "rule_name", "severity", "full_description", "level", "security_severity",
                       F.col("first_seen.file_path").alias("first_file"))


@query(_planted(
    "SELECT CAST(sum(n) AS BIGINT) AS total_findings, CAST(sum(n) FILTER (severity = 'critical') AS BIGINT) AS critical, "
    "CAST(sum(n) FILTER (severity = 'high') AS BIGINT) AS high, "
    "string_agg(concat(severity, '=', n), ',' ORDER BY severity) AS by_severity "
    "FROM (SELECT severity, count(*) AS n FROM found GROUP BY severity)"))
def json_summary(spark, sf_dir):
    summary = rollup.json_summary(_planted_findings(spark, sf_dir))
    entries = F.transform(F.map_entries("by_severity"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return summary.withColumn("by_severity", F.array_join(F.array_sort(entries), ","))


@query(_planted(
    "SELECT count(*) AS finding_count, count(*) > 0 AS has_findings, count(*) FILTER (severity = 'critical') AS critical_count, "
    "count(*) FILTER (severity = 'high') AS high_count FROM found"))
def totals(spark, sf_dir):
    return rollup.totals(_planted_findings(spark, sf_dir))


@query(_planted("SELECT severity, severity_rank, count(*) AS n FROM found GROUP BY severity, severity_rank"))
def severity_table(spark, sf_dir):
    return rollup.severity_table(_planted_findings(spark, sf_dir))


@query(scan_sql("documents", ["doc_id"],
                "SELECT count(*) > 0 AS has_findings, " + ", ".join(
                    f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
                + ", CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM found"))
def verdict(spark, sf_dir):
    return rollup.verdict(scan_documents(spark, sf_dir))


@query(_planted("SELECT count(*) > 0 AS has_findings, " + ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
    + ", 'fail' AS verdict FROM found"))
def planted_verdict(spark, sf_dir):
    return rollup.verdict(_planted_findings(spark, sf_dir))


# --- entropy -------------------------------------------------------------------------------

_TOKENS = "(SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS token FROM documents) WHERE token <> '')"
_SHARE = "((length(token) - length(replace(token, c, ''))) / length(token))"


def _entropy_sql(characters: str) -> str:
    return f"coalesce(list_sum(list_transform({characters}, lambda c: -{_SHARE} * log2({_SHARE}))), 0.0)"


_ENTROPY = _entropy_sql("list_distinct(string_split(token, ''))")
_HEX = "0123456789abcdef"


def _tokens(spark, sf_dir) -> DataFrame:
    # Tokens repeat heavily: distinct ones first, so that each is scored once.
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("token"))
    return words.where("token <> ''").distinct()


@query(f"SELECT token, round({_ENTROPY}, 9) + 0.0 AS entropy, "
       f"round({_entropy_sql(f'list_filter(list_distinct(string_split(token, {quote(str())})), lambda c: contains({quote(_HEX)}, c))')}, 9) "
       f"+ 0.0 AS hex_entropy FROM {_TOKENS}")
def entropy_tokens(spark, sf_dir):
    token = F.col("token")
    return _tokens(spark, sf_dir).select(
        "token", (F.round(shannon_entropy(token), 9) + 0.0).alias("entropy"),
        (F.round(shannon_entropy(token, _HEX), 9) + 0.0).alias("hex_entropy"))


@query(f"SELECT token FROM {_TOKENS} WHERE length(token) >= 16 AND {_ENTROPY} >= 3.5")
def high_entropy_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).where(is_high_entropy(F.col("token"), 3.5))


# --- streams -------------------------------------------------------------------------------

@query(scan_sql(duckdb_sql("planted_events"), ["event_id"],
                "SELECT event_id, line_number, rule_id, matched_text FROM found"))
def stream_scan_events(spark, sf_dir):
    """The events read as a stream and scanned by the batch plan; the written findings are read back."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = events.select("event_id", F.concat(
        "props", F.lit("\napi_key = \""), F.lpad(F.col("event_id").cast("string"), 12, "k"), F.lit('"')).alias("text"))
    folder = scratch_dir(spark)
    write_findings(scan_stream(stream, "text"), f"{folder}/findings", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/findings").select("event_id", "line_number", "rule_id", "matched_text")


_USER_EVENTS = ("(SELECT event_type, concat(props, chr(10), 'api_key = ', chr(34), lpad(cast(user_id AS string), 12, 'k'), chr(34)) "
                "AS text FROM events)")


@query(scan_sql(_USER_EVENTS, ["event_type"], "SELECT DISTINCT event_type AS target, rule_id, matched_text FROM found"))
def stream_dedup_events(spark, sf_dir):
    """Each user's secret once per type of event, however often it arrives before the watermark passes it."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = events.select(F.col("event_type").alias("target"), F.col("ts").cast("timestamp").alias("ts"), F.concat(
        "props", F.lit("\napi_key = \""), F.lpad(F.col("user_id").cast("string"), 12, "k"), F.lit('"')).alias("text"))
    found = drop_repeats(scan_stream(stream, "text"), "ts", "60 days", key=("target", "rule_id", "matched_text"))
    folder = scratch_dir(spark)
    write_findings(found, f"{folder}/findings", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/findings").select("target", "rule_id", "matched_text")


@query(scan_sql(_USER_EVENTS.replace("event_type, concat", "event_type, event_id, concat"), ["event_type", "event_id"],
                "SELECT event_type AS target, rule_id, matched_text, min(event_id) AS event_id FROM found GROUP BY ALL"))
def stream_first_events(spark, sf_dir):
    """The smallest event of each user's secret per type of event, from events that come in no order."""
    folder = scratch_dir(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props", F.col("ts").cast("timestamp").alias("ts"))
    # Row groups are small, as one is read by one task only and a trigger takes few files.
    events.repartition(8, F.xxhash64("event_id")).write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/in")
    # A last event, long after the others, moves the watermark past them.
    last = events.agg((F.max("ts") + F.expr("INTERVAL 61 DAYS")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"), F.lit(0).cast("long").alias("user_id"), F.lit("").alias("props"), "ts")
    last.select(*[F.col(f.name).cast(f.dataType) for f in events.schema]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    stream = stream.select("event_id", F.col("event_type").alias("target"), "ts", F.concat(
        "props", F.lit("\napi_key = \""), F.lpad(F.col("user_id").cast("string"), 12, "k"), F.lit('"')).alias("text"))
    found = keep_first(scan_stream(stream, "text"), "ts", "60 days", order=("event_id",), key=("target", "rule_id", "matched_text"))
    write_findings(found, f"{folder}/findings", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}/findings").where("target <> 'end'")
    return found.select("target", "rule_id", "matched_text", "event_id")
