from collections import Counter

from pyspark.sql import functions as F

from leaksieve.llm.quality_rules import host_verdicts, keep_by_rules, quality_rules
from tests.llm.data import ODD_SCHEMA, empty_frame, odd_frame, words


def base(text):
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_odd_rows(spark):
    frame = odd_frame(spark)
    got = Counter(tuple(r)[:7] for r in quality_rules(frame).collect())
    assert got == Counter((r.doc_id, *base(r.text)) for r in frame.collect())


def test_empty_table(spark):
    assert quality_rules(empty_frame(spark)).collect() == []
    assert keep_by_rules(empty_frame(spark)).collect() == []


GOOD, BAD = " ".join(f"word{i}" for i in range(60)), "too short"


def test_hosts_are_shrunk(spark):
    """A host of failures goes with its good page; a host of one bad and one good page stays."""
    rows = [("spam", BAD)] * 40 + [("spam", GOOD)] + [("fine", GOOD)] * 40 + [("small", BAD), ("small", GOOD)] + [(None, GOOD), (None, BAD)]
    rows += [(f"h{i}", GOOD) for i in range(20)]
    frame = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules(frame).collect()}
    assert kept == {i: t == GOOD and h != "spam" for i, (h, t) in enumerate(rows)}
    assert {r.doc_id for r in keep_by_rules(frame).collect()} == {i for i, k in kept.items() if k}


def test_rates(spark):
    frame = spark.createDataFrame([("a", True)] * 3 + [("a", False)] + [("b", False)] * 4, "source string, f boolean")
    rates = {r.host: r.rate for r in host_verdicts(frame, "source", F.col("f")).collect()}
    mean, var = 0.375, 0.28125
    strength = 1.0 if mean * (1 - mean) / var - 1 <= 0 else mean * (1 - mean) / var - 1
    assert rates["a"] == (3 + mean * strength) / (4 + strength) and rates["b"] == mean * strength / (4 + strength)


def test_clashing_columns_stay(spark):
    frame = odd_frame(spark).withColumn("_rules", F.lit("mine")).withColumn("_words", F.lit(1)).withColumn("host", F.lit("h"))
    kept = keep_by_rules(frame)
    assert kept.columns == frame.columns
    assert {r._rules for r in kept.collect()} == {"mine"}
    assert ODD_SCHEMA.split(",")[0] == "doc_id long"
