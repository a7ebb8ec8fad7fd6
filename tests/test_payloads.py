import base64
import json

from leaksieve.plans.sources import scan_payloads
from leaksieve.sources.payloads import on_branch, read_payloads

SECRET = "pwd = 'abcdefghij'"


def entry(path, content, **more):
    name = path.rsplit("/", 1)[-1]
    return {"repo": "o/r", "default_branch": "trunk", "ref": "trunk", "type": "file", "path": path, "name": name,
            "content_b64": content, **more}


def encoded(data):
    return base64.encodebytes(data if isinstance(data, bytes) else data.encode()).decode()


def payloads(spark, tmp_path, entries):
    path = tmp_path / "payloads.jsonl"
    path.write_text("\n".join(map(json.dumps, entries)))
    return read_payloads(spark, str(path))


def test_scan(spark, tmp_path):
    frame = payloads(spark, tmp_path, [
        entry("a/x.py", encoded("#" * 200 + "\n" + SECRET)),
        entry("a/dist/x.py", encoded(SECRET)),
        entry("a/x.bin", encoded(SECRET)),
        entry("my.key", encoded(SECRET)),
        entry("bad.py", encoded(SECRET.encode() + b"\xff")),
        entry("broken.py", "YWJj="),
        entry("empty.py", ""),
        entry("null.py", None),
        entry("d.py", None, type="dir"),
        entry("other.py", encoded(SECRET), ref="dev"),
    ])
    scan = scan_payloads(frame)
    assert {(r.target, r.file_path, r.line_number, r.matched_text) for r in scan.findings.collect()} == {
        ("o/r", "a/x.py", 2, SECRET), ("o/r", "my.key", 1, SECRET)}
    assert {r.source_id for r in scan.scan_log.collect()} == {
        "a/x.py", "my.key", "bad.py", "broken.py", "empty.py", "null.py"}
    assert [r.file_path for r in scan_payloads(frame, branch="dev").findings.collect()] == ["other.py"]


def test_default_branch(spark, tmp_path):
    frame = payloads(spark, tmp_path, [
        entry("a.py", "", default_branch=None, ref="main"), entry("b.py", "", default_branch=None, ref="x"),
        entry("c.py", "", ref="main")])
    assert [r.path for r in on_branch(frame).collect()] == ["a.py"]
    assert [r.path for r in on_branch(frame.drop("default_branch")).orderBy("path").collect()] == ["a.py", "c.py"]
