import datetime
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from leaksieve.plans.scan import scan_text
from leaksieve.operators.history import first_occurrences
from leaksieve.streaming.scans import _microseconds, drop_repeats, keep_first, scan_stream, write_findings
from tests.conftest import SF_DIR
from workload.tables import table


def test_stream_equals_batch(spark, tmp_path):
    batch = table(spark, SF_DIR, "planted_documents").repartition(5)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = scan_stream(stream, "text")
    assert found.isStreaming
    write_findings(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = scan_text(batch, "text")
    assert got.count() == expected.count() == 200 * 84
    assert got.exceptAll(expected).count() == 0


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    rows = [("t", "f.py", "c1", "2024-01-01 00:00:00", "token = 'abcdefgh'"), ("t", "f.py", "c1", "2024-01-01 00:01:00", "token = 'abcdefgh'"),
            ("t", "f.py", "c2", "2024-01-01 00:02:00", "token = 'abcdefgh'")]
    frame = spark.createDataFrame(rows, "target string, file_path string, commit_sha string, at string, text string")
    frame.withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    found = drop_repeats(scan_stream(stream, "text"), "at", "10 minutes")
    write_findings(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.commit_sha for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c1", "c2"]


SCHEMA = "target string, file_path string, rule_id string, matched_text string, commit_sha string, patch_pos int, line_pos int, at timestamp, snippet string"


def test_first_by_place_equals_batch_for_late_rows(spark, tmp_path):
    """Rows in any order over many batches, some before the watermark by less than the delay: the first by place wins."""
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(60):
        begun = start + datetime.timedelta(minutes=rng.randrange(600))
        for i in range(rng.randrange(1, 8)):
            rows.append(("t", f"f{k % 7}", "r", "secret", f"c{k}", rng.choice([0, 1, None]), rng.randrange(9) * 10 + i, begun + datetime.timedelta(minutes=rng.randrange(25)), f"s{k}-{i}"))
    # They arrive by time, but up to half an hour late.
    rows.sort(key=lambda r: r[7] + datetime.timedelta(minutes=rng.randrange(30)))
    end = ("end", "", "", "", "", 0, 0, start + datetime.timedelta(days=2), "")
    for n, part in enumerate([rows[i:i + 30] for i in range(0, len(rows), 30)] + [[end]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03d}"))
    for n, folder in enumerate(sorted((tmp_path / "in").iterdir())):
        for file in folder.glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 10 * n,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = keep_first(stream, "at", "60 minutes")
    assert found.columns == stream.columns
    write_findings(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out"))
    expected = first_occurrences(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(repr, got.where("target <> 'end'").select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))
    arrived = {}
    for r in rows:
        arrived.setdefault(r[4], r[8])
    assert sum(arrived[r.commit_sha] != r.snippet for r in expected.collect()) > 20


def _firsts(spark, folder, batches, delay):
    """What ``keep_first`` finds in batches of rows (key, place, minute, note)."""
    schema = "key string, place int, at timestamp, note string"
    for n, rows in enumerate(batches):
        rows = [(k, p, None if m is None else datetime.datetime(2024, 3, 1) + datetime.timedelta(minutes=m), s) for k, p, m, s in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
        for file in (folder / "in" / f"{n:03d}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 10 * n,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    found = keep_first(stream, "at", delay, order=("place",), key=("key",))
    write_findings(found, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = spark.read.schema(schema).parquet(f"{folder}/out").where("note <> 'end'")
    return sorted((r.key or "", r.note) for r in got.collect())


def test_first_by_place_is_kept_without_python(spark, tmp_path):
    """Each key's state is called for in the engine: a call of a Python worker per key takes most of the time."""
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    plan = keep_first(stream, "at", "60 minutes")._jdf.queryExecution().toString()
    assert "TransformWithState" not in plan and "Python" not in plan and "session_window" in plan


@pytest.mark.parametrize("together", [True, False])
def test_first_by_place_does_not_depend_on_batches(spark, tmp_path, together):
    """Rows no further apart than the delay are one, those further apart are not, also if they come in one batch."""
    rows = [("far", 2, 0, "far-early"), ("far", 1, 121, "far-late"), ("chain", 3, 0, "c0"), ("chain", 1, 60, "c1"), ("chain", 2, 120, "c2"),
            (None, 5, 10, "null-5"), (None, None, 20, "null-null"), ("once", None, 30, "once"), ("twice", 4, 40, "same"), ("twice", 4, 40, "same")]
    rows.sort(key=lambda r: r[2])
    batches = [rows] if together else [[r] for r in rows]
    got = _firsts(spark, tmp_path, [*batches, [("end", 0, 1000, "end")]], "60 minutes")
    assert got == [("", "null-null"), ("chain", "c1"), ("far", "far-early"), ("far", "far-late"), ("once", "once"), ("twice", "same")]


def test_key_is_settled_when_the_watermark_reaches_its_newest_row(spark, tmp_path):
    """A row is late by the delay of its own time alone, whatever else its key holds."""
    batches = [[("a", 9, 100, "a9"), ("b", 9, 100, "b9")], [("a", 5, 41, "a5"), ("c", 1, 160, "c1")], [("a", 1, 99, "late")],
               [("d", 1, 161, "d1")], [("a", 1, 99, "too late"), ("a", 7, 130, "a7")]]
    assert _firsts(spark, tmp_path, [*batches, [("end", 0, 9000, "end")]], "60 minutes") == [
        ("a", "a7"), ("a", "late"), ("b", "b9"), ("c", "c1"), ("d", "d1")]


def test_delay_has_one_length_in_every_time_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert _microseconds(spark, "60 days") == 60 * 86_400_000_000
        assert _microseconds(spark, "1 month 2 hours 1.5 seconds") == (31 * 86_400 + 7_201) * 1_000_000 + 500_000
        # The clock is put forward on March 10th, so that local days are an hour shorter there.
        rows = [("k", 2, 0, "early"), ("k", 1, 10 * 1440 - 1, "near"), ("far", 2, 0, "far-early"), ("far", 1, 10 * 1440 + 1, "far-late")]
        assert _firsts(spark, tmp_path, [rows, [("end", 0, 90_000, "end")]], "10 days") == [
            ("far", "far-early"), ("far", "far-late"), ("k", "near")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_row_without_time_is_an_error(spark, tmp_path):
    with pytest.raises(StreamingQueryException, match="A row has no at"):
        _firsts(spark, tmp_path, [[("k", 1, None, "n"), ("k", 2, 5, "t")]], "60 minutes")


def test_negative_delay_is_an_error(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="negative"):
        keep_first(stream, "at", "-1 minutes")
