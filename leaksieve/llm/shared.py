"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leaksieve.deploy import ship_package


BATCH_BYTES = "8m"

_recorders: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="leaksieve-llm-")
    folder = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"
    for recorder in _recorders:
        recorder.append(folder)
    return folder


@contextmanager
def recorded_folders() -> Iterator[list[str]]:
    """The folders that operators take in the block, for whoever knows when their results have been used."""
    folders: list[str] = []
    _recorders.append(folders)
    try:
        yield folders
    finally:
        _recorders.remove(folders)


def delete_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes folders of ``shared_folder`` in whatever file system they are."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of texts for Python of at most ``BATCH_BYTES``, which a task holds several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task's function that gives the memory it used back to the system, as Spark keeps its worker."""
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)
    return tidied


def written(frame: DataFrame) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read back."""
    spark = frame.sparkSession
    folder = shared_folder(spark)
    with _small_batches(spark):
        frame.write.parquet(folder)
    table = spark.read.schema(frame.schema).parquet(folder)
    table._llm_folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` or ``bucketed`` that no plan still to run reads, and their names in the catalogue."""
    for table in tables:
        delete_folders(table.sparkSession, [table._llm_folder])
        if name := getattr(table, "_llm_table", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def bucketed(frame: DataFrame, column: str, buckets: int | None = None,
             each: Callable[[Iterator], Iterator] | None = None) -> DataFrame:
    """The frame as a table in the shared folder, bucketed and sorted by ``column``: joins on it do not shuffle it.

    There are ``buckets`` of them, or as many as shuffles have partitions. ``each`` is run over the batches of a bucket, and leaves
    the columns as they are.
    """
    spark = frame.sparkSession
    name, folder = f"llm_{uuid.uuid4().hex}", shared_folder(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartition(buckets, column)
    if each is not None:
        dealt = dealt.mapInArrow(tidy(each), frame.schema)
    with _small_batches(spark):
        dealt.write.bucketBy(buckets, column).sortBy(column).option("path", folder).saveAsTable(name)
    table = spark.table(name)
    table._llm_folder, table._llm_table = folder, name
    return table


def python_ready(frame: DataFrame) -> DataFrame:
    """The frame, after the executors have been given this package for Python stages."""
    ship_package(frame.sparkSession)
    return frame


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
