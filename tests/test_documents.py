"""One document per scan, written by many tasks."""

import json
import os
import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from leaksieve.plans.sources import scan_history, scan_table
from leaksieve.sinks import joined
from leaksieve.sinks.documents import write_report_file, write_sarif_file
from leaksieve.sinks.joined import read_joined, write_joined
from leaksieve.sinks.tables import JSON_COLUMNS, write_table
from tests.test_reports import SECRET, TEXTS

ODD = 'Path not found: "x"\n]é'


@pytest.fixture(scope="module")
def scan(spark):
    more = [(f"many{i % 7}.py", f"line\ntoken = '{SECRET}{i}'") for i in range(300)] + [("same.py", f"pwd = '{SECRET}'")] * 200
    return scan_table(spark.createDataFrame(TEXTS + more, "path string, text string").repartition(6), "text", "path", "t")


@pytest.fixture(scope="module")
def findings(scan, tmp_path_factory):
    return write_table(scan.findings, str(tmp_path_factory.mktemp("run") / "findings"))


@pytest.fixture(scope="module")
def errors(spark):
    return spark.createDataFrame([(ODD,), (None,), ("b",), ("b",)], "message string")


@pytest.fixture(autouse=True)
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_json_report_is_one_file(scan, findings, errors, tmp_path):
    path = str(tmp_path / "report.json")
    write_report_file(findings, scan.scan_log, path, errors, target='a "target"', scan_type="table", duration_seconds=1.23456)
    assert os.listdir(tmp_path) == ["report.json"] or {n for n in os.listdir(tmp_path) if not n.endswith(".crc")} == {"report.json"}
    report = json.load(open(path, encoding="utf-8"))
    assert list(report) == ["version", "scan", "summary", "findings", "errors"]
    assert report["scan"] == {"target": 'a "target"', "type": "table", "files_scanned": 503, "duration_seconds": 1.235}
    assert report["summary"]["total_findings"] == len(report["findings"]) == findings.count()
    assert sorted(report["errors"]) == sorted([ODD, "", "b", "b"])
    assert all(list(f) == list(JSON_COLUMNS) for f in report["findings"]) and SECRET not in json.dumps(report["findings"])
    # Files, then lines, in order.
    places = [(f["file_path"], f["line_number"]) for f in report["findings"]]
    assert places == sorted(places)


def test_sarif_is_one_file(findings, errors, tmp_path):
    path = (tmp_path / "scan.sarif").as_uri()
    write_sarif_file(findings, path, errors)
    [run] = json.load(open(tmp_path / "scan.sarif", encoding="utf-8"))["runs"]
    assert len(run["results"]) == findings.count() > 500
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert ids == list(dict.fromkeys(r["ruleId"] for r in run["results"]))
    [invocation] = run["invocations"]
    assert not invocation["executionSuccessful"]
    assert sorted(n["message"]["text"] for n in invocation["toolExecutionNotifications"]) == sorted([ODD, "", "b", "b"])
    assert SECRET not in json.dumps(run)


def test_nothing_found(spark, findings, tmp_path):
    write_sarif_file(findings.limit(0), str(tmp_path / "s"))
    [run] = json.load(open(tmp_path / "s"))["runs"]
    assert run["results"] == run["tool"]["driver"]["rules"] == [] and run["invocations"] == [{"executionSuccessful": True, "toolExecutionNotifications": []}]
    write_report_file(findings.limit(0), findings.limit(0), str(tmp_path / "r"), target="t", scan_type="table")
    report = json.load(open(tmp_path / "r"))
    assert report["findings"] == report["errors"] == [] and report["summary"]["total_findings"] == 0
    # A file that is there is replaced.
    write_report_file(findings.limit(1), findings, str(tmp_path / "r"), target="t", scan_type="table")
    assert len(json.load(open(tmp_path / "r"))["findings"]) == 1


def test_history_without_lines(spark, tmp_path):
    patch = spark.createDataFrame(
        [("r", "c1", None, 0, "A", "d", "x.py", 0, f"+token = '{SECRET}'")],
        "repo string, commit_sha string, parent_sha string, seq long, author string, committed_at string, file_path string, patch_pos int, patch string")
    write_sarif_file(scan_history(patch).findings, str(tmp_path / "s"), redact_snippets=False)
    [result] = json.load(open(tmp_path / "s"))["runs"][0]["results"]
    assert result["properties"] == {"commit_sha": "c1", "commit_author": "A", "commit_date": "d"}
    assert "region" not in result["locations"][0]["physicalLocation"]


def test_parts_are_joined_in_order_and_cleared(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") < 3000, 0).otherwise(2).alias("section"), F.col("id").cast("string").alias("value"))
    write_joined(rows, str(tmp_path / "out"), ["<", "|", "|", ">"])
    text = open(tmp_path / "out").read()
    assert text == "<" + ",".join(map(str, range(3000))) + "||" + ",".join(map(str, range(3000, 5000))) + ">"
    assert [n for n in os.listdir(tmp_path) if "parts" in n] == []


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select(F.lit(0).alias("section"), F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="stop"):
        write_joined(rows, str(tmp_path / "out"), ["[", "]"])
    assert not (tmp_path / "out").exists()


def test_one_file_is_read_back_by_many_tasks(spark, tmp_path):
    """The entries of a document, each with its array's name, are lines that ranges of the file give in several tasks."""
    path = str(tmp_path / "out")
    values = [json.dumps({"id": i, "text": "]   \x85, [" + "x" * (i % 50)}, ensure_ascii=i % 2 == 0) for i in range(3000)]
    rows = spark.createDataFrame([(0, v) for v in values] + [(2, '"a, ]"')], "section int, value string")
    write_joined(rows.orderBy("section"), path, ['{"n":1,"things":[', '],"none":[', '],"notes":[', "]}"], lines=True)
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    frame, entries = read_joined(spark, path, range_bytes=10_000)
    assert json.loads(frame) == {"n": 1, "things": [], "none": [], "notes": []}
    assert entries.rdd.getNumPartitions() > 5
    found = {}
    for r in entries.collect():
        found.setdefault(r.member, []).append(json.loads(r.value))
    assert sorted(found.pop("things"), key=lambda r: r["id"]) == sorted(whole["things"], key=lambda r: r["id"]) and len(whole["things"]) == 3000
    assert found == {"notes": ["a, ]"]} == {"notes": whole["notes"]}


def _bytes(folder, name="") -> int:
    total = 0
    for place, _, names in os.walk(folder):
        for found in names:
            if found.startswith(name):
                try:
                    total += os.lstat(f"{place}/{found}").st_size
                except FileNotFoundError:
                    pass
    return total


@contextmanager
def _watched(folder):
    """The most bytes that lie below a folder meanwhile, as far as they are seen."""
    most, stop = [0], threading.Event()

    def watch():
        while not stop.wait(0.001):
            most[0] = max(most[0], _bytes(folder))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        yield most
    finally:
        stop.set()
        watcher.join()


def _many_findings(findings, path):
    """Findings of different texts, some 40 MB of a document."""
    text = F.concat(*[F.sha2(F.concat("file_path", F.lit(f"{i}"), "id"), 512) for i in range(4)])
    many = findings.limit(1).crossJoin(findings.sparkSession.range(0, 40_000, 1, 8)).withColumns(
        {"file_path": F.concat("file_path", "id"), "snippet": text, "masked_snippet": text}).drop("id")
    return write_table(many, path)


def test_report_is_not_held_twice(findings, tmp_path):
    """a part goes when it is in the file."""
    many = _many_findings(findings, str(tmp_path / "findings"))
    os.mkdir(tmp_path / "out")
    with _watched(tmp_path / "out") as most:
        write_report_file(many, findings.limit(0), str(tmp_path / "out" / "r"), target="t", scan_type="table")
    size = os.path.getsize(tmp_path / "out" / "r")
    assert size > 30_000_000 and most[0] < 1.3 * size


def test_sarif_is_not_held_twice(findings, errors, tmp_path):
    """the same with sections of rules, results and notes."""
    many = _many_findings(findings, str(tmp_path / "findings"))
    os.mkdir(tmp_path / "out")
    with _watched(tmp_path / "out") as most:
        write_sarif_file(many, str(tmp_path / "out" / "s"), errors)
    size = os.path.getsize(tmp_path / "out" / "s")
    assert size > 30_000_000 and most[0] < 1.3 * size
    [run] = json.load(open(tmp_path / "out" / "s", encoding="utf-8"))["runs"]
    assert len(run["results"]) == 40_000 and len(run["tool"]["driver"]["rules"]) == 1 and len(run["invocations"][0]["toolExecutionNotifications"]) == 4


def test_shuffle_goes_before_the_file_begins(spark, monkeypatch, tmp_path):
    """what tasks have sorted is in the parts, and no longer in the shuffle."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [folder.getPath() for folder in manager.localDirs()]
    rows = spark.range(0, 200_000, 1, 4).select(F.lit(0).alias("section"), F.sha2(F.col("id").cast("string"), 512).alias("value"))

    def shuffled():
        return sum(_bytes(folder, "shuffle_") for folder in folders)

    before, left, join = shuffled(), [], joined._join

    def late(*arguments):
        for _ in range(100):
            if shuffled() <= before:
                break
            time.sleep(0.1)
        left.append(shuffled())
        join(*arguments)

    monkeypatch.setattr(joined, "_join", late)
    spark.conf.unset(joined._DROP_SHUFFLES)
    was = spark.conf.get(joined._DROP_SHUFFLES)
    write_joined(rows.orderBy("value"), str(tmp_path / "out"), ["[", "]"])
    assert left and left[0] <= before and os.path.getsize(tmp_path / "out") > 200_000 * 128
    assert spark.conf.get(joined._DROP_SHUFFLES) == was


def test_failed_joins_leave_nothing(spark, tmp_path):
    """where the file cannot take its place, neither it nor its parts stay."""
    os.makedirs(tmp_path / "out" / "full")
    rows = spark.range(0, 100, 1, 4).select(F.lit(0).alias("section"), F.lit("x").alias("value"))
    with pytest.raises(OSError):
        write_joined(rows, str(tmp_path / "out"), ["[", "]"])
    assert os.listdir(tmp_path) == ["out"] and os.listdir(tmp_path / "out") == ["full"]
