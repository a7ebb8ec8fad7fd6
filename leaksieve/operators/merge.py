"""The canonical findings schema and bag unions over it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FINDING_COLUMNS = (
    ("source_type", "string"), ("target", "string"), ("source_id", "string"), ("file_path", "string"),
    ("line_number", "int"), ("ord", "int"), ("rule_id", "string"), ("rule_name", "string"),
    ("severity", "string"), ("severity_rank", "int"), ("snippet", "string"), ("masked_snippet", "string"),
    ("matched_text", "string"), ("commit_sha", "string"), ("commit_author", "string"), ("commit_date", "string"), ("description", "string"),
)
LOG_SCHEMA = "source_type string, target string, source_id string"
ERROR_SCHEMA = "source_type string, target string, source_id string, stage string, message string"


def canonical(found: DataFrame, **columns: Column) -> DataFrame:
    """``found`` with exactly the canonical columns; absent ones are null."""
    def pick(name: str) -> Column:
        if name in columns:
            return columns[name]
        return F.col(name) if name in found.columns else F.lit(None)

    return found.select(*[pick(name).cast(kind).alias(name) for name, kind in FINDING_COLUMNS])


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)


def files_scanned(scan_log: DataFrame) -> DataFrame:
    """Scanned units per source type: files, or commits for history."""
    return scan_log.groupBy("source_type").agg(F.count("*").alias("files_scanned"))
