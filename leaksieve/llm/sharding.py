"""Shards by a two-pass external shuffle, in DataFrame functions only.

The first pass scatters records into buckets of about ``bucket_bytes`` of text by seeded hashes: the
shard is decided by ``doc_id`` and the number of shards alone, the shard whose hash with the id is largest (one
more shard takes rows only into itself), the bucket within the shard by the id and the row's number, so that
an id on very many rows is spread over its shard's buckets. The second pass has a task for every bucket, which gathers it,
shuffles it (``shuffle`` is Fisher-Yates over an array) and writes it. A bucket is the largest thing in memory.

A record's slot is its place in its shard: the records of the shard's earlier buckets, and its place in
its bucket. The counts of buckets are summed, not the records.

Defined results: a null text has one byte and the checksum of an empty text; a null ``doc_id`` is an id like any
other; repeated rows are kept as often as they occur; an empty table gives empty shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leaksieve.llm.shared import free_name, shared_folder

SHARDS = 8
BUCKET_BYTES = 8 << 20


def shard_of(doc_id: Column, shards: int, seed: int = 1) -> Column:
    """The shard whose hash with the id is largest."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(doc_id, F.lit(seed), F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(shards))))["i"]


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """Writes all rows of ``docs`` as Parquet, one folder per shard, and reads them back.

    Three columns are added: ``shard``, ``bucket`` and ``place`` (in the bucket), with underscores before
    them where ``docs`` has columns of these names.
    """
    spark = docs.sparkSession
    shard, bucket, place, row, rows, part = (free_name(docs, x) for x in ("shard", "bucket", "place", "_row", "_rows", "_part"))
    total = docs.agg(F.sum(text_bytes()).alias("b")).first().b or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    in_shard = F.pmod(F.xxhash64("doc_id", row, F.lit(seed + 1)), F.lit(buckets)).cast("int")
    placed = numbered.withColumn(part, shard_of(F.col("doc_id"), shards, seed) * buckets + in_shard)
    # The number of the bucket is that of the task.
    dealt = placed.repartitionById(shards * buckets, part)
    gathered = dealt.groupBy(part).agg(F.sort_array(F.collect_list(F.struct(row, *docs.columns))).alias(rows)).select(
        F.floor(F.col(part) / buckets).cast("int").alias(shard), (F.col(part) % buckets).cast("int").alias(bucket), rows)
    shuffled = gathered.select(shard, bucket, F.posexplode(F.shuffle(rows, seed)).alias(place, rows)).select(
        *(F.col(rows)[c].alias(c) for c in docs.columns), bucket, place, shard)
    folder = folder or shared_folder(spark)
    shuffled.write.partitionBy(shard).parquet(folder)
    return spark.read.schema(shuffled.schema).parquet(folder)


def shard_slots(docs: DataFrame, shards: int = SHARDS, seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row, from the written shards."""
    stored = write_shards(docs.select("doc_id", "text"), shards, seed, bucket_bytes)
    records = stored.select("doc_id", text_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                            "shard", "bucket", "place")
    counts = stored.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return records.join(starts, ["shard", "bucket"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("place")).alias("slot"), shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"))
