"""One text file from many tasks: tasks write compressed parts, which are then joined.

A task writes the rows of its partition, separated by commas, to a part of its own per section; what a failed or
repeated attempt wrote is never joined. The parts are copied, in the order of partitions, between the texts that
belong around the sections, a block at a time: neither a task nor the driver holds more than a block. Sort the rows by section and
whatever order the file is to have.

What lies on disk meanwhile: while tasks write, the sort's shuffle and the compressed parts; then the file, and the parts that are
not yet in it. The shuffle goes before the file begins, a part as soon as it is copied.

Where every entry is a line of its own, ``read_joined`` reads the file in ranges, each by a task of its own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from leaksieve.deploy import ship_package
from leaksieve.sources.ranges import read_ranges

BLOCK = 8 << 20
#: Bytes of the file that one task reads.
RANGE_BYTES = 16 << 20
#: Rows that a task puts together at once.
ROWS = 256

_PARTS = "section int, part int, name string"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def _clear(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def _write_parts(parts: str, between: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the rows of a partition to compressed files of the folder ``parts``, one per section; returns their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(parts)
        context, names, streams = TaskContext.get(), {}, {}
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    pairs = zip(some.column("section").to_pylist(), some.column("value").to_pylist())
                    for section, rows in groupby(pairs, itemgetter(0)):
                        text = between.join(value for _, value in rows)
                        if section not in streams:
                            store.create_dir(folder, recursive=True)
                            names[section] = f"{folder}/{section}-{context.partitionId()}-{context.taskAttemptId()}"
                            streams[section] = store.open_output_stream(names[section], compression="zstd", buffer_size=BLOCK)
                        else:
                            text = between + text
                        streams[section].write(text.encode("utf-8"))
        finally:
            for stream in streams.values():
                stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(names.keys(), pa.int32()), pa.array([context.partitionId()] * len(names), pa.int32()),
                                          pa.array(names.values(), pa.string())], names=["section", "part", "name"])
    return run


def _join(store: fs.FileSystem, whole: str, names: dict[int, list[str]], around: list[str], end: str) -> None:
    """Copies the parts into one file; each is deleted when it has been copied, so that nothing is held twice but one part."""
    try:
        with store.open_output_stream(f"{whole}.tmp", compression=None, buffer_size=BLOCK) as out:
            for section, before in enumerate(around):
                out.write(before.encode("utf-8"))
                for i, name in enumerate(names.get(section, [])):
                    out.write((f",{end}" if i else end).encode("utf-8"))
                    with store.open_input_stream(name, compression="zstd") as part:
                        while block := part.read(BLOCK):
                            out.write(block)
                    store.delete_file(name)
                if section in names:
                    out.write(end.encode("utf-8"))
        store.move(f"{whole}.tmp", whole)
    except BaseException:
        if store.get_file_info(f"{whole}.tmp").type == fs.FileType.File:
            store.delete_file(f"{whole}.tmp")
        raise


def write_joined(rows: DataFrame, path: str, around: list[str], lines: bool = False) -> None:
    """Writes rows (section, value), in their order, as one file: ``around[0]``, section 0, ``around[1]``, section 1 and so on.

    With ``lines`` every entry is a line of its own; entries must not hold line feeds then.
    """
    spark, end = rows.sparkSession, "\n" if lines else ""
    ship_package(spark)
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    store, folder = _store(parts)
    try:
        with _shuffles_dropped(spark):
            found = rows.select("section", "value").mapInArrow(_write_parts(parts, f",{end}"), _PARTS).collect()
        names: dict[int, list[str]] = {}
        for row in sorted(found, key=lambda r: r.part):
            names.setdefault(row.section, []).append(row.name)
        _join(store, _store(path)[1], names, around, end)
    finally:
        _clear(store, folder)


def read_joined(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[str, DataFrame]:
    """A document of ``write_joined`` with ``lines`` whose sections are arrays of JSON objects or strings: the document with these arrays empty, and rows
    (member, value) with the name of its array and the JSON text of every entry.
    """
    pieces = read_ranges(spark, path.removeprefix("file://"), range_bytes)
    lines = pieces.select("lines_before", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("pos", "value")).where("value <> ''")
    # Lines before a piece are counted by more boundaries than line feeds: these numbers ascend, and may have gaps.
    lines = lines.select((F.col("lines_before") + F.col("pos")).alias("number"), "value")
    # What is around the sections: the first line, and lines that close an array, which no entry begins with.
    around = lines.where((F.col("number") == 0) | F.startswith("value", F.lit("]"))).orderBy("number").collect()
    member = F.lit(None).cast("string")
    for line in around:
        opened = re.search(r'"([^"]+)":\[$', line.value)
        member = F.when(F.col("number") > line.number, F.lit(opened[1] if opened else None)).otherwise(member)
    entries = lines.where(~F.col("number").isin([line.number for line in around]))
    return "".join(line.value for line in around), entries.select(member.alias("member"), F.regexp_replace("value", ",$", "").alias("value"))
