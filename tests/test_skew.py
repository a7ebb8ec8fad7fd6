"""Whole and right results when a third of all rows share one key."""

import json

import pytest
from pyspark.sql import functions as F

from leaksieve.operators.order import report_order
from leaksieve.plans.sources import scan_history, scan_table
from leaksieve.sinks.documents import sarif_documents
from leaksieve.sinks.tables import write_table

N = 6000


@pytest.fixture(scope="module")
def patches(spark):
    """A third of all patches add the same secret to one file of one commit of one repository."""
    hot = F.col("id") % 3 == 0
    return spark.range(N).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("repo"),
        F.when(hot, "c").otherwise(F.concat(F.lit("c"), "id")).alias("commit_sha"),
        F.when(hot, 0).otherwise(F.col("id")).alias("seq"),
        F.lit("Ann").alias("author"), F.lit("2024").alias("committed_at"), F.lit("x.py").alias("file_path"),
        F.col("id").cast("int").alias("patch_pos"),
        F.concat(F.lit("+pwd = 'abcdefghij' #"), "id", F.lit("\n+pwd = 'abcdefghij' again")).alias("patch"))


def test_dedup(patches):
    findings = scan_history(patches).findings.collect()
    assert len(findings) == N - N // 3 + 1
    assert [r.snippet for r in findings if r.target == "hot"] == ["pwd = 'abcdefghij' #0"]


def test_depth(patches):
    assert scan_history(patches, depth=2).findings.count() == 1 + 50 * 2


@pytest.fixture(scope="module")
def findings(spark, tmp_path_factory):
    """A third of the texts carry the same name."""
    texts = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), "id")).alias("path"),
        F.lit("pwd = 'abcdefghij'").alias("text"))
    return write_table(scan_table(texts, "text", "path", "t").findings, str(tmp_path_factory.mktemp("run") / "f"))


def test_report_order_keeps_copies(findings):
    paths = [r.file_path for r in report_order(findings).select("file_path").collect()]
    assert len(paths) == N and paths == sorted(paths) and paths.count("hot") == N // 3


def test_documents_hold_every_finding_once(findings):
    runs = [json.loads(r.value)["runs"][0] for r in sarif_documents(findings, max_bytes=40_000).collect()]
    assert max(len(run["results"]) for run in runs) <= 500
    uris = [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for run in runs for r in run["results"]]
    assert len(uris) == N and uris.count("hot") == N // 3
