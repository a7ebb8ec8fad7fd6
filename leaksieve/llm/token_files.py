"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds consecutive documents: a header, the documents' ids and places, the places of the blocks, and
the blocks. A block has ``BLOCK_IDS`` ids (the last may have fewer), each in as many bits as the
vocabulary's largest id needs, low bits first. A block begins at a byte, so any range of ids is read by
its blocks alone and unpacked by numpy at once.

Documents are dealt out by ranges of their id; a task encodes its range in order and closes a file
every ``FILE_IDS`` ids, so that its memory is bounded. It returns a row per closed file. Files of failed or
repeated attempts have other names and are not in that manifest, which Spark commits. Files are
written and read through pyarrow's file systems (local and mounted folders, HDFS, object stores).

Defined results: a null or empty text is the end id alone; rows with a null ``doc_id`` come first; rows with
one id are in an order of their texts' hash; a document longer than a file makes its file longer.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from leaksieve.llm.chunks import broadcast_vocabulary, encoded, library_encode, worker_encoder
from leaksieve.llm.shared import python_ready, shared_folder, tidy, written

MAGIC = b"LSIDS1\0\0"
_HEADER = struct.Struct("<8sIIQQ")  # magic, bits per id, ids per block, documents, ids
BLOCK_IDS = 4096
FILE_IDS = 1 << 22
#: Ids that a reader unpacks at once, or those of one document.
READ_IDS = 1 << 19
_MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


def bits_for(vocabulary_size: int) -> int:
    """The bits that every id below ``vocabulary_size`` fits in."""
    return max(1, (vocabulary_size - 1).bit_length())


def _overlap(bits: int) -> Iterator[tuple[int, int, int]]:
    """Of eight ids in ``bits`` bytes: each (id, byte, left shift of the id to the byte) that share a bit."""
    for i in range(8):
        for byte in range(i * bits // 8, (i * bits + bits - 1) // 8 + 1):
            yield i, byte, i * bits - 8 * byte


def pack(ids: np.ndarray, bits: int) -> bytes:
    padded = np.zeros(8 * -(-len(ids) // 8), np.uint64)
    padded[:len(ids)] = ids
    # Eight ids stand in one column and become ``bits`` bytes.
    columns = np.ascontiguousarray(padded.reshape(-1, 8).T)
    out = np.zeros((bits, columns.shape[1]), np.uint64)
    for i, byte, shift in _overlap(bits):
        out[byte] |= columns[i] << np.uint64(shift) if shift >= 0 else columns[i] >> np.uint64(-shift)
    return (out & np.uint64(255)).astype(np.uint8).T.tobytes()[:-(-len(ids) * bits // 8)]


def unpack(data, bits: int, n: int) -> np.ndarray:
    raw, out, mask = np.frombuffer(data, np.uint8), np.zeros(n, "<u4"), np.uint64((1 << bits) - 1)
    # Some blocks at a time, as bytes are wide integers meanwhile.
    for a in range(0, n, 8 * BLOCK_IDS):
        b = min(a + 8 * BLOCK_IDS, n)
        rows = -(-(b - a) // 8)
        part = np.zeros(rows * bits, np.uint64)
        own = raw[a * bits // 8:-(-b * bits // 8)]
        part[:len(own)] = own
        columns, found = np.ascontiguousarray(part.reshape(rows, bits).T), np.zeros((8, rows), np.uint64)
        for i, byte, shift in _overlap(bits):
            found[i] |= columns[byte] >> np.uint64(shift) if shift >= 0 else columns[byte] << np.uint64(-shift)
        out[a:b] = (found & mask).T.ravel()[:b - a]
    return out


def file_parts(doc_ids: np.ndarray, named: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[bytes]:
    """The bytes of a file. ``starts`` has an entry more than there are documents; ``named`` tells ids from nulls."""
    blocks = [pack(ids[a:a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    yield _HEADER.pack(MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids))
    yield doc_ids.astype("<i8").tobytes()
    yield np.packbits(named, bitorder="little").tobytes()
    yield starts.astype("<i8").tobytes()
    yield np.cumsum([0, *map(len, blocks)]).astype("<i8").tobytes()
    yield from blocks


class TokenFile:
    """An open file; reads the tables at once and blocks when they are asked for."""

    def __init__(self, path: str):
        system, name = _file_system(path)
        self.file = system.open_input_file(name)
        magic, self.bits, self.block, self.n_docs, self.n_ids = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        n_blocks, at, sizes = -(-self.n_ids // self.block), _HEADER.size, []
        for size in (8 * self.n_docs, -(-self.n_docs // 8), 8 * (self.n_docs + 1), 8 * (n_blocks + 1)):
            sizes.append(self.file.read_at(size, at))
            at += size
        self.doc_ids = np.frombuffer(sizes[0], "<i8")
        self.named = np.unpackbits(np.frombuffer(sizes[1], np.uint8), count=self.n_docs, bitorder="little").astype(bool)
        self.starts, self.places, self.data = np.frombuffer(sizes[2], "<i8"), np.frombuffer(sizes[3], "<i8"), at

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``, from their blocks only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        raw = self.file.read_at(int(self.places[last] - self.places[first]), self.data + int(self.places[first]))
        # Full blocks have whole bytes (4096 ids of any width), so that a range of blocks is one run of bits.
        found = unpack(raw, self.bits, min(last * self.block, self.n_ids) - first * self.block)
        return found[start - first * self.block:stop - first * self.block]

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.starts[row]), int(self.starts[row + 1]))


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _write(vocabulary, folder: str, end_id: int | None, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder("library", vocabulary, library_encode)
        system, name = _file_system(folder)
        part, n_files = TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal docs, sizes, ids, held, n_files
            column = pa.concat_arrays(docs)
            flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            file = f"{name}/part-{part:06d}-{n_files:05d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(file) as out:
                for piece in file_parts(column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), starts, flat, bits):
                    out.write(piece)
            row = pa.record_batch({
                "part": pa.array([part], pa.int32()), "file": pa.array([n_files], pa.int32()),
                "path": [f"{folder}/{file.rpartition('/')[2]}"], "n_docs": [len(column)], "n_ids": [len(flat)]})
            docs, sizes, ids, held, n_files = [], [], [], 0, n_files + 1
            return row

        for batch in batches:
            for first, last, found, bounds in encoded(batch.column("text"), encoder):
                if end_id is not None:
                    found = np.insert(found, bounds[1:], end_id)
                docs.append(batch.column("doc_id").slice(first, last - first))
                sizes.append(np.diff(bounds) + (end_id is not None))
                ids.append(found)
                held += len(found)
                if held >= FILE_IDS:
                    yield close()
        if docs:
            yield close()
    return run


def write_token_files(docs: DataFrame, vocabulary_path: str, vocabulary_size: int, end_id: int | None, folder: str | None = None) -> DataFrame:
    """Encodes all rows of ``docs`` (doc_id, text) to files in ascending order of ``doc_id``; the manifest with each file's ``start``."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    system, name = _file_system(folder)
    system.create_dir(name, recursive=True)
    # The hash and the row's number split a doc_id that many rows have.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    placed = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    vocabulary = broadcast_vocabulary(docs, vocabulary_path)
    manifest = written(placed.mapInArrow(tidy(_write(vocabulary, folder, end_id, bits_for(vocabulary_size))), _MANIFEST))
    # One narrow row for some megabytes of ids: their running sum is a small table's.
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            file = TokenFile(path)
            a = 0
            while a < file.n_docs:
                base = int(file.starts[a])
                b = max(a + 1, int(np.searchsorted(file.starts, base + READ_IDS, side="right")) - 1)
                ids = file.ids(base, int(file.starts[b])).astype("<u4")
                edges = (file.starts[a:b + 1] - base).tolist()
                yield pa.record_batch({
                    "doc_id": pa.array(file.doc_ids[a:b], pa.int64(), mask=~file.named[a:b]),
                    "start": pa.array(file.starts[a:b] + start, pa.int64()),
                    "n_tokens": pa.array(np.diff(file.starts[a:b + 1]), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[x:y].tobytes()) for x, y in zip(edges, edges[1:])], pa.int64())})
                a = b


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files, a few files to a task."""
    files = written(manifest.select("path", "start"))
    spark = python_ready(manifest).sparkSession
    tasks = max(1, min(files.count(), max(spark.sparkContext.defaultParallelism, files.count() // 4)))
    return files.repartition(tasks).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, vocabulary_path: str, vocabulary_size: int, end_id: int) -> DataFrame:
    return read_token_files(write_token_files(docs, vocabulary_path, vocabulary_size, end_id))
