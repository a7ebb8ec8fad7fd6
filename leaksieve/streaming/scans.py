"""Scans of streams. Up to the findings a scan keeps no state, so the batch plan runs unchanged.

Two ways to drop repeats: ``drop_repeats`` passes on whichever row of a key arrives first, at once. ``keep_first`` gives what the
batch dedup gives, the first row of a key by its place, however rows arrive, as soon as the watermark says that none is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leaksieve.plans.scan import scan_text
from leaksieve.rules import RuleSet

HISTORY_KEY = ("target", "file_path", "rule_id", "matched_text", "commit_sha")


def scan_stream(texts: DataFrame, text: str, rules: RuleSet | None = None) -> DataFrame:
    """Findings of a streaming DataFrame; all other columns are carried along."""
    return scan_text(texts, text, rules)


def drop_repeats(findings: DataFrame, event_time: str, delay: str,
                 key: tuple[str, ...] = HISTORY_KEY) -> DataFrame:
    """First arrival per key; keys are forgotten once the watermark passes them."""
    return findings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def _microseconds(spark: SparkSession, delay: str) -> int:
    """The length of an interval, with 31 days a month as in a watermark's delay."""
    part = {name: f"extract({name} FROM CAST('{delay}' AS INTERVAL))" for name in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")}
    days = f"(({part['YEAR']} * 12 + {part['MONTH']}) * 31 + {part['DAY']})"
    seconds = f"({days} * 86400 + {part['HOUR']} * 3600 + {part['MINUTE']} * 60 + {part['SECOND']})"
    return spark.sql(f"SELECT CAST({seconds} * 1000000 AS BIGINT)").first()[0]


def keep_first(findings: DataFrame, event_time: str, delay: str, order: tuple[str, ...] = ("patch_pos", "line_pos"),
               key: tuple[str, ...] = HISTORY_KEY) -> DataFrame:
    """First row per key by ``order``, with nulls first, in append mode; a key's state is one row.

    A key is settled once the watermark passes its newest row: equal to the batch dedup as long as a key's rows are not further apart
    than ``delay``. Rows further apart than that begin the key anew, one behind the watermark is dropped, one without a time is an error.
    ``spark.sql.streaming.stateStore.providerClass`` is set to RocksDB if it is not set, so that the keys are not held in the heap.
    """
    spark = findings.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting, ""):
        spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    length = _microseconds(spark, delay)
    if length < 0:
        raise ValueError(f"The delay is negative: {delay}")
    # A row's session begins the delay before the row and ends with it. So the sessions of rows no further apart than the delay are
    # one, which ends with the newest row; and the newest beginning is the watermark that the delay gives. Counted in microseconds,
    # as a day of an interval is a day of the session's time zone.
    length = max(length, 1)
    at = F.coalesce(F.col(f"`{event_time}`"), F.raise_error(F.lit(f"A row has no {event_time}")).cast("timestamp"))
    names = [f"__key{i}" for i in range(len(key))]
    rows = findings.select(
        *[F.col(f"`{c}`").alias(name) for c, name in zip(key, names, strict=True)],
        F.timestamp_micros(F.unix_micros(at) - length).alias("__begin"),
        F.struct(*[F.col(f"`{c}`") for c in order]).alias("__place"), F.struct(*[F.col(f"`{c}`") for c in findings.columns]).alias("__row"))
    sessions = rows.withWatermark("__begin", "0 seconds").groupBy(*names, F.session_window("__begin", f"{length} microseconds"))
    return sessions.agg(F.min_by("__row", "__place").alias("__first")).select("__first.*")


def write_findings(findings: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Starts writing findings to parquet files; without ``trigger`` it processes what is there and ends."""
    writer = (findings.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()
