"""The bounded sample of labelled texts that a classifier is fitted on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Longer texts are not drawn for fitting; they are scored like all others.
MAX_FIT_BYTES = 1 << 16
#: Bytes of all texts drawn: the fit runs on the driver, and takes some twenty times as much for their n-grams.
SAMPLE_BYTES = 24 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int, max_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """At most ``rows`` pairs (text, label) whose ``doc_id`` satisfies ``learn_from``, with texts of at most ``max_bytes`` in all.

    Both bounds cut the same order, that of a hash. The ids are the first in order of a hash of the id, so that the sample does not depend on partitions.
    They are at most ``rows`` numbers, a proven bound, and are broadcast to the scan of the texts.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn_from).select(
        F.col("doc_id").alias("key"), F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= MAX_FIT_BYTES)
    found = texts.join(F.broadcast(chosen), "key").select("key", "text", "label")
    # An id on many rows must not make the sample larger.
    order = [F.xxhash64("key", "text"), F.col("key")]
    drawn = found.orderBy(*order).limit(rows)
    # At most ``rows`` rows are left, so that one task can add up their sizes.
    size = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return drawn.withColumn("size", size).where(F.col("size") <= max_bytes).select("key", "text", "label").toArrow()


def remainder(divisor: int, column: str = "doc_id") -> Column:
    """The CRC-32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
