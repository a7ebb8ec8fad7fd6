import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from leaksieve.llm.sharding import shard_of, shard_slots, write_shards
from tests.llm.data import empty_frame, odd_frame


def check(frame, rows, shards=8):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < shards and r.grown_shard in (r.shard, shards)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(s) == 1 for s in by_id.values())


def test_odd_rows(spark):
    frame = odd_frame(spark)
    check(frame, shard_slots(frame, bucket_bytes=1000).collect())


def test_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard_slots(frame, bucket_bytes=1 << 14).collect()
    check(frame, rows)
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 8 and max(counts.values()) < 2 * min(counts.values())
    # Shuffled: the order within a shard is not the order of ids.
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert ids != sorted(ids) and abs(sum(a < b for a, b in zip(ids, ids[1:])) / len(ids) - 0.5) < 0.2
    assert [tuple(r) for r in shard_slots(frame, bucket_bytes=1 << 14).orderBy("shard", "slot").collect()] == \
        [tuple(r) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]


def test_shards_keep_columns(spark):
    frame = odd_frame(spark).withColumn("shard", F.lit("s")).withColumn("place", F.lit(3))
    stored = write_shards(frame, 4)
    assert stored.columns == [*frame.columns, "bucket", "_place", "_shard"]
    assert Counter(tuple(r)[:len(frame.columns)] for r in stored.collect()) == Counter(tuple(r) for r in frame.collect())


def test_every_bucket_has_its_task(spark):
    """No task gathers two buckets."""
    frame = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 50 + cast(id % 7 AS int)) AS text").repartition(5)
    stored = write_shards(frame, 4, bucket_bytes=4000)
    tasks = stored.select("shard", "bucket", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task")).distinct().collect()
    assert len(tasks) == len({(r.shard, r.bucket) for r in tasks}) == len({r.task for r in tasks}) > 40
    sizes = Counter((r.shard, r.bucket) for r in stored.collect())
    assert max(sizes.values()) < 3 * min(sizes.values())


def test_law_needs_the_id_only(spark):
    a = spark.range(1000).select("id", shard_of(F.col("id"), 8).alias("s")).collect()
    b = spark.range(1000).repartition(7).select("id", shard_of(F.col("id"), 8).alias("s")).collect()
    assert dict(a) == dict(b)


def test_empty_table(spark):
    assert shard_slots(empty_frame(spark)).collect() == []
