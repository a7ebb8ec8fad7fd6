"""Approximate nearest neighbours by inner product: inverted lists, scanned a few dimensions at a time.

Vectors get one more component, ``sqrt(M**2 - |x|**2)`` with M the largest length, by which a larger inner
product is a smaller distance. They are turned by a random rotation, so that the distance over the first d
of D dimensions, times D / d, estimates the whole one. k-means on a bounded sample makes the lists.

A list is scanned in column blocks. The exact distances to some vectors of the sample and to the list's first give
each query a threshold. After each column block a pair is dropped when its estimate exceeds the threshold by more than the
estimate's error allows (factor ``1 + ERROR / sqrt(d)``); only pairs that are left go on to the next block. Pairs that reach the
end get their exact inner product, in double precision on the original vectors.

The number of lists a query probes is measured, not set: on the sample, the smallest number that finds
``RECALL`` of the true neighbours of sample queries; clustered vectors need few lists, random ones most. The scan itself is run on
the sample too, and ``ERROR`` grows until it loses at most ``LOSS`` of what the lists hold. A query probes more lists until they hold
k + 1 vectors, as lists of clustered vectors may be small; one that still comes back with fewer than k, because
the scan dropped too much, is searched again in all lists without dropping anything. Every row
is indexed. A list is scanned in blocks of at most ``VECTORS`` vectors and ``QUERIES`` queries, so a list with a
third of all rows is many tasks; within a block equal vectors are scanned once.

Defined results: vectors that are null, zero, or hold a null or a value that is not finite take no part, as queries or
candidates. There is no inner product of vectors of different lengths: those of another length than most take no part
either. Rows equal in id and vector are one row; rows of one id with different vectors are different queries and candidates,
so that an id may come up in its own result, and its ranks repeat. Ties go to the smaller id. A query has
k neighbours, or all other rows if these are fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leaksieve.llm.shared import python_ready, written

SAMPLE = 1 << 14
#: Long vectors have a smaller sample, of at most this many bytes, and at most a quarter of it as anchors.
SAMPLE_BYTES = 64 << 20
MAX_LISTS = 1 << 10
RECALL = 0.96
VECTORS, QUERIES = 1 << 12, 1 << 10
COLUMNS = 16
#: Vectors of the sample by which a query's distance to its k-th neighbour is bounded before any list is scanned.
ANCHORS = 1 << 13
#: One pair in so many must be left for a column block to be a matrix product.
FEW = 16
ERRORS = (2.1, 3.0, 4.5, np.inf)
LOSS = 0.01


@dataclass
class Index:
    rotation: np.ndarray
    largest: float  # M squared
    centres: np.ndarray
    probes: int
    anchors: np.ndarray | None = None  # turned vectors of the sample, which limit a query's distances, and their lists
    anchor_lists: np.ndarray | None = None
    error: float = ERRORS[0]

    def turned(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Vectors with the additional component (0 for queries), rotated."""
        more = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.largest - (vectors ** 2).sum(1), 0))
        return np.column_stack([vectors, more]) @ self.rotation

    def distances(self, turned: np.ndarray) -> np.ndarray:
        """Squared distances to the centres, but for a constant per row."""
        return (self.centres ** 2).sum(1) - 2 * (turned @ self.centres.T)

    def nearest(self, turned: np.ndarray, n: int) -> np.ndarray:
        found = self.distances(turned)
        if n >= len(self.centres):
            return np.tile(np.arange(len(self.centres)), (len(turned), 1))
        return np.argpartition(found, n - 1, axis=1)[:, :n]


def fit_index(sample: np.ndarray, rows: int, largest: float, k: int, seed: int = 5) -> Index:
    """Rotation, centres and the number of probes from a sample of the table's ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    rotation, upper = np.linalg.qr(rng.normal(size=(size, size)))
    index = Index(rotation * np.sign(np.diag(upper)), largest, np.zeros((1, size)), 1)
    turned = index.turned(sample)
    lists = int(max(1, min(MAX_LISTS, rows ** 0.5, len(sample) / 8)))
    index.centres = turned[rng.choice(len(turned), lists, replace=False)]
    for _ in range(8):
        owner = index.nearest(turned, 1)[:, 0]
        sums, n = np.zeros_like(index.centres), np.bincount(owner, minlength=lists)
        np.add.at(sums, owner, turned)
        index.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], index.centres)
    owner = index.nearest(turned, 1)[:, 0]
    picked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    scores = sample[picked] @ sample.T
    scores[np.arange(len(picked)), picked] = -np.inf
    anchors = min(ANCHORS, max(2 * k, SAMPLE_BYTES // (32 * size)))
    chosen = rng.choice(len(turned), min(anchors, len(turned)), replace=False)
    index.anchors, index.anchor_lists = turned[chosen], owner[chosen]
    k = min(k, len(sample) - 1)
    if k > 0 and lists > 1:
        true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(index.distances(index.turned(sample[picked], queries=True)), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(lists)[None], axis=1)
        needed = np.sort(np.take_along_axis(rank, owner[true], axis=1).ravel())
        index.probes = int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1
    if k > 0:
        _fit_error(index, sample, picked, owner, k)
    return index


def _fit_error(index: Index, sample: np.ndarray, picked: np.ndarray, owner: np.ndarray, k: int) -> None:
    """Sets the error that a scan of the sample's lists needs to lose few of the neighbours in them."""
    queries = sample[picked]
    probed = np.zeros((len(picked), len(index.centres)), bool)
    np.put_along_axis(probed, index.nearest(index.turned(queries, queries=True), index.probes), True, axis=1)
    scores = np.where(probed[:, owner], queries @ sample.T, -np.inf)
    scores[np.arange(len(picked)), picked] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    there = np.isfinite(np.take_along_axis(scores, true, axis=1))
    # The limit that a query's own lists give it, as in the search.
    distances = np.where(probed[:, owner], _distances(index.turned(queries, queries=True), index.turned(sample)), np.inf)
    limit = np.partition(distances, k, axis=1)[:, k] if len(sample) > k else None
    for index.error in ERRORS:
        kept = np.zeros(scores.shape, bool)
        kept[scan_block(index, queries, sample, k + 1, limit)] = True
        if (np.take_along_axis(kept, true, axis=1) & there).sum() >= (1 - LOSS) * there.sum():
            return


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _vector_lists(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = index.value.nearest(index.value.turned(_matrix(batch.column("vec"))), 1)[:, 0]
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "key": batch.column("key"), "list": pa.array(found, pa.int32()), "vec": batch.column("vec")})
    return run


def _query_lists(index, k: int, held: np.ndarray, all_lists: bool):
    """A row per query and list to probe: the nearest ones, until they hold ``k`` + 1 vectors, or all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = len(index.value.centres)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                turned = index.value.turned(_matrix(part.column("vec")), queries=True)
                order = np.argsort(index.value.distances(turned), axis=1)
                enough = (held[order].cumsum(1) <= k).sum(1) + 1
                count = np.full(len(order), lists) if all_lists else np.minimum(np.maximum(enough, index.value.probes), lists)
                taken = np.arange(lists) < count[:, None]
                limit = np.full(part.num_rows, np.inf)
                if not all_lists and len(index.value.anchors) > k:
                    # Of the lists that are probed, so that as many vectors are found within the limit.
                    probed = np.zeros(order.shape, bool)
                    np.put_along_axis(probed, order, taken, axis=1)
                    near = np.where(probed[:, index.value.anchor_lists], _distances(turned, index.value.anchors), np.inf)
                    limit = np.partition(near, k, axis=1)[:, k]
                rows = pa.array(np.repeat(np.arange(part.num_rows), count))
                yield pa.record_batch({"query_id": part.column("vec_id").take(rows), "key": part.column("key").take(rows),
                                       "list": pa.array(order[taken], pa.int32()), "vec": part.column("vec").take(rows),
                                       "limit": pa.array(limit).take(rows)})
    return run


def scan_block(index: Index, queries: np.ndarray, vectors: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, vector row) of a block that the adaptive scan does not drop.

    ``limit`` is a distance within which each query has ``k`` vectors somewhere; the block's first vectors may give a smaller one.
    """
    q, x = index.turned(queries, queries=True), index.turned(vectors)
    size, first = x.shape[1], min(len(x), max(2 * k, 64))
    limit = np.full(len(q), np.inf) if limit is None else limit
    if first >= k:
        limit = np.minimum(limit, np.partition(_distances(q, x[:first]), k - 1, axis=1)[:, k - 1])
    # Room for rounding: the parts of a distance are as large as the vectors, not as the distance.
    limit = (limit * (1 + 1e-9) + 1e-11 * ((q ** 2).sum(1) + index.largest))[:, None]
    part, left, d = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool), 0
    # While many pairs are left, a column block is one matrix product for all of them.
    while d < size and left.sum() * FEW > left.size:
        e = min(d + COLUMNS, size)
        part += _distances(q[:, d:e], x[:, d:e])
        d = e
        left &= part <= limit * _slack(index, d, size)
    rows, columns = np.nonzero(left)
    partial = part[rows, columns]
    while d < size and len(rows):
        e = min(d + COLUMNS, size)
        partial = partial + ((q[rows, d:e] - x[columns, d:e]) ** 2).sum(1)
        d = e
        stays = partial <= limit[rows, 0] * _slack(index, d, size)
        rows, columns, partial = rows[stays], columns[stays], partial[stays]
    return rows, columns


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * (q @ x.T)


def _slack(index: Index, d: int, size: int) -> float:
    """How large the part of a distance over d of all dimensions may be, as a share of the limit."""
    return 1.0 if d == size else (1 + index.error / np.sqrt(d)) ** 2 * d / size


def _scan(index, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        q, x = _matrix(queries.column("vec")), _matrix(vectors.column("vec"))
        ids, keys = (vectors.column(c).to_numpy() for c in ("vec_id", "key"))
        order = np.argsort(ids, kind="stable")
        ids, keys, x = ids[order], keys[order], x[order]
        # Of equal vectors only the k + 1 smallest ids can be in a result of k, the query's own left out.
        _, group, counts = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True, return_counts=True)
        if counts.max() > k + 1:
            by_group = np.argsort(group, kind="stable")
            nth = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = np.sort(by_group[nth <= k])
            ids, keys, x = ids[keep], keys[keep], x[keep]
        rows, columns = scan_block(index.value, q, x, k + 1, queries.column("limit").to_numpy())
        names, own = queries.column("query_id").to_numpy(), queries.column("key").to_numpy()
        other = (names[rows] != ids[columns]) | (own[rows] != keys[columns])
        rows, columns = rows[other], columns[other]
        # One sum per pair in the same order of components, so that equal vectors have equal scores.
        score = np.concatenate([np.zeros(0), *((q[rows[a:a + 65536]] * x[columns[a:a + 65536]]).sum(1) for a in range(0, len(rows), 65536))])
        best = np.lexsort((ids[columns], -score, rows))
        begin = np.searchsorted(rows[best], rows[best])
        best = best[np.arange(len(best)) - begin < k]
        return pa.table({"query_id": names[rows[best]], "key": own[rows[best]], "vec_id": ids[columns[best]], "score": score[best]}, schema=schema)
    return run


def _search(queries: DataFrame, vectors: DataFrame, index, k: int) -> DataFrame:
    """``(query_id, key, vec_id, score, rank)``: the best ``k`` of the lists that the rows of ``queries`` name."""
    # At most MAX_LISTS rows: how many blocks of vectors and of queries each list has.
    blocks = vectors.groupBy("list").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("nv")).join(
        queries.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq")), "list")
    blocks = F.broadcast(written(blocks))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = queries.join(blocks, "list").withColumn("qb", F.pmod("key", "nq").cast("int")).withColumn("vb", every("nv")).drop("nv", "nq")
    right = vectors.join(blocks, "list").withColumn("vb", F.pmod("key", "nv").cast("int")).withColumn("qb", every("nq")).drop("nv", "nq")
    found = left.groupBy("list", "qb", "vb").cogroup(right.groupBy("list", "qb", "vb")).applyInArrow(
        _scan(index, k), "query_id long, key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product with each row that ``is_query`` holds for."""
    spark = python_ready(table).sparkSession
    vec = F.col(embedding).cast("array<double>")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & (F.size("vec") > 0))
    usable = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = written(rows.where(usable).distinct().select("vec_id", F.xxhash64("vec").alias("key"), "vec"))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == sizes.d)
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first().m
    size = min(SAMPLE, max(4 * k, SAMPLE_BYTES // (8 * sizes.d)))
    sample = rows.orderBy(F.xxhash64("vec_id", "key"), "vec_id").limit(size).toArrow()
    fitted = fit_index(_matrix(sample.column("vec")), sizes.n, longest, k)
    index = spark.sparkContext.broadcast(fitted)

    vectors = written(rows.mapInArrow(_vector_lists(index), "vec_id long, key long, list int, vec array<double>"))
    held = np.zeros(len(fitted.centres), np.int64)
    for r in vectors.groupBy("list").count().collect():
        held[r.list] = r["count"]

    def queries(chosen: DataFrame, all_lists: bool) -> DataFrame:
        run = _query_lists(index, k, held, all_lists)
        return written(chosen.mapInArrow(run, "query_id long, key long, list int, vec array<double>, limit double"))

    found = written(_search(queries(rows.where(is_query), False), vectors, index, k))
    result = found.select("query_id", "rank", "vec_id", "score")
    complete = found.where(F.col("rank") == min(k, sizes.n - 1)).select(F.col("query_id").alias("vec_id"), "key")
    short = written(rows.where(is_query).join(complete, ["vec_id", "key"], "left_anti")) if sizes.n > 1 else None
    if short is None or short.isEmpty():
        return result
    exact = spark.sparkContext.broadcast(replace(fitted, error=np.inf))
    again = _search(queries(short, True), vectors, exact, k)
    kept = found.join(complete.withColumnRenamed("vec_id", "query_id"), ["query_id", "key"], "left_semi")
    return kept.unionByName(again).select("query_id", "rank", "vec_id", "score")
