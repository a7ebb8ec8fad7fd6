"""Inputs of the queries: the given tables, and tables derived from them by SQL both engines run.

Each entry is a SELECT whose ``{name}`` placeholders stand for other tables of this module or for
the given ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leaksieve.plans.partitioning import dealt
from workload.planted import block_sql

GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()

_DOC_KEY = "cast(doc_id AS string)"
_TURN_KEY = "cast(conv_id * 1000 + turn AS string)"

DERIVED = {
    # Every row carries one line per rule below its own text.
    "planted_documents":
        f"SELECT doc_id, concat(text, chr(10), {block_sql(_DOC_KEY)}) AS text FROM {{documents}}",
    "planted_conversations":
        f"SELECT conv_id, turn, role, concat(text, chr(10), {block_sql(_TURN_KEY)}) AS text FROM {{conversations}}",
    "planted_events":
        "SELECT event_id, ts, concat(props, chr(10), 'api_key = ', chr(34), "
        "lpad(cast(event_id AS string), 12, 'k'), chr(34)) AS text FROM {events}",
    # Documents whose spaces after full stops became rarer line boundaries.
    "odd_lines":
        "SELECT doc_id, replace(replace(replace(text, '. ', concat('.', chr(13), chr(10))), ', ', "
        "concat(',', chr(12))), ' of ', concat(chr(28), 'of', chr(11))) AS text FROM {documents}",
    # Commits: one per document and repository, the text added as a file, some lines removed.
    "patches":
        "SELECT source AS repo, md5(cast(doc_id AS string)) AS commit_sha, cast(NULL AS string) AS parent_sha, "
        "doc_id AS seq, CASE WHEN lang = 'de' THEN NULL ELSE concat('dev-', lang) END AS author, "
        "concat('2024-01-01T00:00:00+00:', lang) AS committed_at, "
        "CASE WHEN lang = 'es' THEN NULL ELSE concat(lang, '/', cast(doc_id AS string), '.txt') END AS file_path, "
        "0 AS patch_pos, "
        "concat('@@ -1 +1,99 @@', chr(10), '-pwd = ', chr(39), 'removed-', cast(doc_id AS string), chr(39), chr(10), "
        "'+', replace(text, chr(10), concat(chr(10), '+')), chr(10), "
        "'+first pwd = ', chr(39), 'shared-', source, chr(39), chr(10), "
        "'+again pwd = ', chr(39), 'shared-', source, chr(39), chr(10), "
        "'+++ pwd = ', chr(39), 'plusplus', cast(doc_id AS string), chr(39), chr(10), "
        "' pwd = ', chr(39), 'context-', cast(doc_id AS string), chr(39)) AS patch FROM {documents}",
    # The same commits with parents: every fifth of a repository lies on a side branch, and every second of these is merged.
    "branched_patches":
        "SELECT *, CASE WHEN rn % 5 = 4 THEN lead(commit_sha, 2) OVER (PARTITION BY repo ORDER BY seq) "
        "ELSE lead(commit_sha, 1) OVER (PARTITION BY repo ORDER BY seq) END AS first_sha, "
        "CASE WHEN rn % 10 = 4 THEN lead(commit_sha, 1) OVER (PARTITION BY repo ORDER BY seq) END AS merged_sha "
        "FROM (SELECT repo, commit_sha, seq, author, committed_at, file_path, patch_pos, patch, "
        "row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM {patches}) AS numbered",
    # The same commits as git log -p writes them, one record per commit.
    "log_records":
        "SELECT source AS repo, doc_id, concat(md5(cast(doc_id AS string)), ' ', md5(concat('p', cast(doc_id AS string))), "
        "chr(10), 'Author:     dev-', lang, ' <dev@example.com>', chr(10), 'AuthorDate: 2024-01-01T00:00:00+00:00', chr(10), "
        "'Commit:     dev <dev@example.com>', chr(10), 'CommitDate: 2024-01-02T00:00:00+00:00', chr(10), chr(10), "
        "'    Add a document', chr(10), chr(10), "
        "'diff --git a/old.py b/old.py', chr(10), 'deleted file mode 100644', chr(10), '--- a/old.py', chr(10), "
        "'+++ /dev/null', chr(10), '@@ -1 +0,0 @@', chr(10), '-pwd = ', chr(39), 'abcdefgh', chr(39), chr(10), "
        "'diff --git a/', lang, '.txt b/', lang, '.txt', chr(10), '--- a/', lang, '.txt', chr(10), '+++ b/', lang, '.txt', "
        "chr(10), '@@ -0,0 +1,99 @@', chr(10), '+', replace(text, chr(10), concat(chr(10), '+')), chr(10), "
        "'+pwd = ', chr(39), 'pass-', cast(doc_id AS string), chr(39), chr(10)) AS value FROM {documents}",
    # Files of a site: path from the page address.
    "site_files":
        "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS repo, "
        "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS rel_path, "
        "regexp_extract(url, '^https?://[^/]+/([^?#]*/)?([^/?#]*)', 2) AS name, "
        "concat(html, chr(10), 'apikey = ', chr(34), 'page-', cast(page_id AS string), '-key', chr(34)) AS html "
        "FROM {pages}",
    # The same files written out as a tree: some of well-known names, some below dotfiles' directories, some with a null byte.
    "tree_files":
        "SELECT doc_id, doc_id % 11 = 0 AS has_null, CASE WHEN doc_id % 13 = 0 THEN concat('src/d', cast(doc_id AS string), '/Dockerfile') "
        "WHEN doc_id % 13 = 1 THEN concat('lib/.d', cast(doc_id AS string), '/.env') ELSE rel_path END AS rel_path, "
        "concat(text, chr(10), 'pwd = ', chr(39), 'in-tree-', cast(doc_id AS string), chr(39), chr(10)) AS text FROM {source_files}",
    # Files whose names and directories follow the language and source of the document.
    "source_files":
        "SELECT doc_id, text, lang, concat("
        "CASE source WHEN 'src1' THEN 'node_modules/' WHEN 'src2' THEN 'lib/vendor/' WHEN 'src3' THEN 'docs/' "
        "WHEN 'src4' THEN 'docs/keep/' WHEN 'src5' THEN 'deep/a/b/generated/' ELSE 'src/' END, "
        "CASE lang WHEN 'en' THEN 'Doc' WHEN 'fr' THEN 'My.Token' WHEN 'de' THEN 'note' ELSE '.hidden' END, "
        "cast(doc_id AS string), "
        "CASE source WHEN 'src6' THEN '.PY' WHEN 'src7' THEN '.bin' WHEN 'src8' THEN '' WHEN 'src9' THEN '.R' "
        "WHEN 'src10' THEN '.test.js' ELSE '.md' END) AS rel_path FROM {documents}",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def duckdb_sql(name: str) -> str:
    """A parenthesised subquery, or the name of a given table."""
    if name in GIVEN:
        return name
    return "(" + _PLACEHOLDER.sub(lambda m: duckdb_sql(m[1]), DERIVED[name]) + ")"


def input_partitions(spark: SparkSession) -> int | None:
    """The partitions that whoever runs the queries wants their inputs dealt into; none are dealt without the setting."""
    wanted = spark.conf.get("spark.leaksieve.inputPartitions", None)
    return int(wanted) if wanted else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    inputs = {m[1]: dealt(table(spark, sf_dir, m[1]), input_partitions(spark)) for m in _PLACEHOLDER.finditer(sql)}
    return spark.sql(sql, **inputs)
