import math
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leaksieve.functions import labels
from leaksieve.functions.entropy import is_high_entropy, shannon_entropy
from leaksieve.functions.paths import directory_parts, file_name, suffix
from leaksieve.functions.redact import redact, redact_all, redact_snippet
from leaksieve.functions.text import decode_base64, decode_lenient, decode_strict, split_lines, strip


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.x for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("length, masked", [
    (0, ""), (1, "a"), (2, "aa"), (3, "aa*"), (6, "aa****"), (7, "aaaaaa*"), (26, "aaaaaa" + "*" * 20),
    (27, "aaaaaa" + "*" * 20), (300, "aaaaaa" + "*" * 20),
])
def test_redact(spark, length, masked):
    assert column(spark, ["a" * length], redact) == [masked]
    long = masked + ("…" if length > 6 else "")
    assert column(spark, ["a" * length], lambda c: redact(c, ellipsis=True)) == [long]


def test_redact_snippet(spark):
    rows = [("x abcdefgh abcdefgh", "abcdefgh", "x abcdef**… abcdefgh"), ("x", "abcdefgh", "x"), ("x", "", "x"),
            ("a.c axc", "axc", "a.c ax*"), ("\U0001f600\U0001f600 abcdefgh!", "abcdefgh", "\U0001f600\U0001f600 abcdef**…!")]
    frame = spark.createDataFrame(rows, "s string, m string, e string")
    for row in frame.withColumn("got", redact_snippet(F.col("s"), F.col("m"))).collect():
        assert row.got == row.e


def test_redact_all_masks_every_match_of_the_line(spark):
    frame = spark.createDataFrame([("db_password='abcdefgh' t=abcdefghij", ["password='abcdefgh'", "db_password='abcdefgh'",
                                                                            "abcdefghij", ""])], "s string, m array<string>")
    assert frame.select(redact_all(F.col("s"), F.col("m"))).first()[0] == "db_pas" + "*" * 16 + "… t=abcdef****…"


def test_labels(spark):
    severities = ["critical", "high", "medium", "low", "other", None]
    assert column(spark, severities, labels.severity_rank) == [4, 3, 2, 1, 0, 0]
    assert column(spark, severities, labels.sarif_level) == ["error", "error", "warning", "note", "warning", "warning"]
    assert column(spark, severities, labels.security_severity) == ["9.5", "7.5", "5.0", "2.5", "5.0", "5.0"]
    assert column(spark, ["a" * 50, "a" * 51], labels.short_description) == ["a" * 50, "a" * 50 + "…"]
    frame = spark.createDataFrame(
        [("f.py", 3, None, None), ("f.py", 0, "0123456789", "Ann"), ("f.py", 0, "0123456789", None), ("f.py", 0, "", "")],
        "p string, n int, sha string, who string")
    rows = frame.select(labels.location(F.col("p"), F.col("n"), F.col("sha")).alias("l"),
                        labels.line_label(F.col("n"), F.col("sha"), F.col("who")).alias("t")).collect()
    assert [r.l for r in rows] == ["f.py:3", "01234567 → f.py:0", "01234567 → f.py:0", "f.py:0"]
    assert [r.t for r in rows] == ["Line 3", "(diff)  commit 01234567 by Ann", "(diff)  commit 01234567", "(diff)"]


def entropy(text, charset=""):
    counted = {c for c in text if not charset or c in charset}
    return sum(-text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in counted)


TOKENS = ["", "aaaa", "a", "0123456789abcde", "0123456789abcdef", "0123456789abcdefg" * 3, "a\U0001f600\U0001f601a",
          "x" * 16, "aGVsbG8gd29ybGQhISEhISE5ODc2NTQzMjE=", "ab" * 100]


@pytest.mark.parametrize("charset", ["", "0123456789abcdef"])
def test_entropy(spark, charset):
    got = column(spark, TOKENS, lambda c: shannon_entropy(c, charset))
    for token, value in zip(TOKENS, got):
        assert value == pytest.approx(entropy(token, charset), abs=1e-12)
        assert math.copysign(1, value) == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0")), min_size=5, max_size=20))
def test_entropy_of_any_text(spark, tokens):
    for token, value in zip(tokens, column(spark, tokens, shannon_entropy)):
        assert value == pytest.approx(entropy(token), abs=1e-9)


def test_high_entropy(spark):
    tokens = ["0123456789abcde", "0123456789abcdef", "0123456789abcdefghijklmn", "a" * 40, ""]
    assert column(spark, tokens, is_high_entropy) == [False, False, True, False, False]
    assert column(spark, tokens, lambda c: is_high_entropy(c, 4.0)) == [False, True, True, False, False]


def test_decode(spark):
    raw = [b"abc", b"", b"a\xffb\xc3", "é\U0001f600".encode(), b"\xed\xa0\x80x", b"\xc0\x80y", b"\xf0\x9f\x98z", None]
    assert column(spark, raw, decode_lenient, "binary") == [
        None if r is None else r.decode("utf-8", errors="ignore") for r in raw]

    def strict(r):
        try:
            return r.decode("utf-8")
        except (UnicodeDecodeError, AttributeError):
            return None
    assert column(spark, raw, decode_strict, "binary") == [strict(r) for r in raw]


def test_base64(spark):
    got = column(spark, ["YWJj", "YWJj\nZGVm\r\n", "YQ==", "YQ", "!Y W?J j", None], decode_base64)
    assert [None if g is None else bytes(g) for g in got[:3]] == [b"abc", b"abcdef", b"a"]
    assert got[3] is None or bytes(got[3]) == b"a"
    assert bytes(got[4]) == b"abc" and got[5] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from(
    "ab \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85   　​ ᠎﻿\U0001f600")), min_size=5, max_size=30))
def test_lines_and_strip(spark, values):
    for value, lines in zip(values, column(spark, values, split_lines)):
        expected = value.splitlines()
        assert lines[:len(expected)] == expected and all(line == "" for line in lines[len(expected):])
    assert column(spark, values, strip) == [v.strip() for v in values]


def test_paths(spark):
    paths = ["a/b/c.py", "c.tar.gz", ".env", "a/.env.local", "Dockerfile", "x.", "a.b/c", "..x"]
    assert column(spark, paths, lambda c: suffix(file_name(c))) == [
        {".": ""}.get(PurePosixPath(p).suffix, PurePosixPath(p).suffix) if p != "..x" else ".x" for p in paths]
    assert column(spark, ["a/b/c.py", "c"], directory_parts) == [["a", "b"], []]
