"""Source trees: the files below a folder or URI, chosen by filters, and read by tasks.

Spark's own file sources hide names that start with a dot or an underscore, among them the
``.env`` files a secret scan is after. Trees on mounted folders are listed by the operating system, trees under
a URI (``s3://``, ``gs://``, ``hdfs://``) by their store; tasks list (``listing``) and read either.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from leaksieve.deploy import ship_package
from leaksieve.operators.files import (
    SNIFF_BYTES,
    ScanConfig,
    outside_excluded_dirs,
    scannable_name,
    size_in_bounds,
)
from leaksieve.operators.ignore import is_ignored, parse_ignore_lines
from leaksieve.sources.listing import REFUSALS, attempts, last_attempt, list_shares, readable
from leaksieve.sources.stores import Tree, open_tree

CONTENT_SCHEMA = "path binary, rel_path string, length long, single boolean, content binary, status string"

# A batch handed back to Spark holds at most about this many bytes of file content.
_BATCH_BYTES = 32 * 1024 * 1024
LISTING_TASKS = 256


def tree_kind(root: str, lister: str | None = None) -> str | None:
    """``file``, ``directory`` or, where there is nothing, None."""
    return open_tree(root, lister).kind()


def tree_found(spark: SparkSession, path: str, config: ScanConfig = ScanConfig(), *, tasks: int = LISTING_TASKS) -> DataFrame:
    """Rows of kind ``file`` and ``error`` (``listing.FOUND_SCHEMA``) for all below a directory. Listed when called."""
    return list_shares(spark, path, frozenset(config.effective_excluded_dirs), tasks, config.lister)


def listed_files(found: DataFrame) -> DataFrame:
    """(path, rel_path, name, length, single) of the files among the rows of ``tree_found``."""
    return found.where("kind = 'file'").select("path", "rel_path", "name", "length", F.lit(False).alias("single"))


def list_tree(spark: SparkSession, path: str, config: ScanConfig = ScanConfig(), *, tasks: int = LISTING_TASKS) -> DataFrame:
    """Every file below ``path`` (a folder or a URI) outside the excluded directories, or ``path`` itself if it is a file."""
    tree = open_tree(path, config.lister)
    if tree.kind() != "file":
        return listed_files(tree_found(spark, path, config, tasks=tasks))
    name = readable(posixpath.basename(tree.root))
    return spark.createDataFrame([(os.fsencode(tree.root), name, name, tree.size(), True)],
                                 "path binary, rel_path string, name string, length long, single boolean")


def ignore_patterns(path: str, config: ScanConfig = ScanConfig()) -> list[str]:
    """The patterns of the root's ignore files, then those of the configuration."""
    patterns: list[str] = []
    tree = open_tree(path, config.lister)
    if tree.kind() == "directory":
        for name in (".gitignore", config.ignore_file):
            try:
                with tree.open(posixpath.join(tree.root, name)) as file:
                    patterns += parse_ignore_lines(file.read().decode("utf-8", "ignore").splitlines())
            except OSError:
                continue
    return patterns + list(config.ignore_patterns)


def select_files(listing: DataFrame, patterns: list[str] | tuple[str, ...] = (),
                 config: ScanConfig = ScanConfig()) -> DataFrame:
    """The files to scan, by ignore patterns, size and name. A single-file target passes as it is."""
    chosen = (outside_excluded_dirs(F.col("rel_path"), config.effective_excluded_dirs)
              & size_in_bounds(F.col("length"), config.max_file_bytes)
              & scannable_name(F.col("name"), config.effective_extensions))
    if patterns:
        chosen = chosen & ~is_ignored(F.col("rel_path"), patterns)
    return listing.where(F.col("single") | chosen)


def read_files(files: DataFrame, tasks: int | None = None, root: str = "", lister: str | None = None) -> DataFrame:
    """Adds ``content`` and ``status`` (``ok``, ``binary`` or ``unreadable``) to the selected files of the tree ``root``.

    The paths are hashed over ``tasks`` tasks first, as listing tasks follow directories and may
    be uneven; only paths and sizes are shuffled. ``root`` matters only if it is a URI.
    """
    spark = files.sparkSession
    ship_package(spark)
    if tasks is None:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                    2 * spark.sparkContext.defaultParallelism)
    columns = files.select("path", "rel_path", "length", "single").repartition(tasks, "path")
    return columns.mapInArrow(partial(_read_batches, root=root, lister=lister, tries=attempts(spark)), CONTENT_SCHEMA)


def _read_batches(batches: Iterator[pa.RecordBatch], root: str, lister: str | None, tries: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.binary()), ("rel_path", pa.string()), ("length", pa.int64()),
                        ("single", pa.bool_()), ("content", pa.binary()), ("status", pa.string())])
    tree, rows, held = open_tree(root, lister), [], 0
    for batch in batches:
        for row in batch.to_pylist():
            row["content"], row["status"] = _read_file(tree, os.fsdecode(row["path"]), not row["single"], tries)
            rows.append(row)
            held += len(row["content"] or b"")
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _read_file(tree: Tree, path: str, sniff: bool, tries: int) -> tuple[bytes | None, str]:
    try:
        with tree.open(path) as file:
            head = file.read(SNIFF_BYTES)
            if sniff and b"\x00" in head:
                return None, "binary"
            return head + file.read(), "ok"
    except OSError as problem:
        # What may pass is left to Spark, which runs the task again.
        if not isinstance(problem, REFUSALS) and not last_attempt(tries):
            raise
        return None, "unreadable"
