import random

import pytest
from pyspark.sql import functions as F

from leaksieve.operators.rule_index import RuleIndex, python_rule_rows, rule_rows, scan_with_index
from leaksieve.plans.filters import may_hold
from leaksieve.plans.scan import scan_text
from leaksieve.rules import Rule, RuleSet
from workload.tables import table

SF = "/root/testdata/sf0.001"


def same(spark, docs, rules):
    """The findings of the index, which must be those of the expressions."""
    expected, found = scan_text(docs, "text", rules), scan_with_index(docs, "text", RuleIndex(rule_rows(spark, rules)))
    assert found.columns == expected.columns and dict(found.dtypes) == dict(expected.dtypes)
    rows = sorted(map(tuple, found.collect()), key=repr)
    assert rows == sorted(map(tuple, expected.collect()), key=repr)
    return rows


def test_catalogue_on_planted_lines(spark):
    rows = same(spark, table(spark, SF, "planted_conversations").select("conv_id", "turn", "text"), RuleSet.builtin())
    assert len({r[3] for r in rows}) == 78


RULES = RuleSet(()).with_rules(
    Rule("plain", "Plain", r"acme_\d{4}", "high"), Rule("anchored", "Anchored", r"^acme", "low", keywords=("acme",)),
    Rule("two", "Two keywords", r"[a-z]+", "low", keywords=("acme", "ACME_1", "k")), Rule("short", "Short", r"(?i)Q.", "low", keywords=("q",)),
    Rule("empty", "Empty match", r"x*", "low", keywords=("zebra crossing",)), Rule("end", "End", r"\d$", "low", keywords=("äöü-key", "acme")),
    Rule("absent", "Absent", r"a", "low", keywords=("not there at all",)), Rule("two", "Same id", r"b", "low", keywords=("crossing",)))


def test_odd_rules_and_texts(spark):
    texts = [None, "", "acme_1234 Acme_12", "a line\nno zebra crossing here\r\nACME_1 and QQ äÖü-KEY 7", "   short ", "acme acme acme acme", "x" * 70000 + " acme_9999"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "id long, text string")
    rows = same(spark, docs, RULES)
    assert {r[3] for r in rows} >= {"plain", "anchored", "two", "short", "empty", "end"}
    assert same(spark, docs.limit(0), RULES) == []


def test_thousands_of_rules_in_one_plan(spark):
    """5,000 rules: the plan is that of five, the findings those of expressions over the rules that occur."""
    rng = random.Random(8)
    rules = [Rule(f"r{i}", f"Rule {i}", f"(?i)name{i:04d}[a-z]*=[0-9]+", "medium", keywords=(f"name{i:04d}",) if i % 3 else ("none", f"me{i:04d}"))
             for i in range(5000)]
    some = rng.sample(range(5000), 60)
    lines = [" ".join(f"{rng.choice(['name', 'NAME', 'xname'])}{i:04d}{rng.choice(['', 'ab'])}={i}" for i in rng.sample(some, 3)) for _ in range(300)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::30])) for i in range(30)], "id long, text string")
    index = RuleIndex(rule_rows(spark, RuleSet(tuple(rules))))
    found = scan_with_index(docs, "text", index)
    kept = RuleSet(tuple(rules[i] for i in sorted(some)))
    columns = ["id", "line_number", "rule_id", "matched_text"]
    rows = sorted(map(tuple, found.select(*columns).collect()))
    assert rows == sorted(map(tuple, scan_text(docs, "text", kept).select(*columns).collect())) and len(rows) == 900

    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()
    few = scan_with_index(docs, "text", RuleIndex(rule_rows(spark, RuleSet(tuple(rules[:5])))))
    assert abs(len(plan(found)) - len(plan(few))) < 200
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and "Python" not in plan(found)


def test_rules_from_a_table(spark):
    rows = spark.createDataFrame([(7, "own", r"\d+\s", ["KEY"]), (9, "bare", "^b", None)], "ord long, rule_id string, pattern string, keywords array<string>")
    rows = rows.selectExpr("ord", "rule_id", "pattern", "coalesce(keywords, array()) AS keywords")
    docs = spark.createDataFrame([("the key is 12 ",), ("b and no digits",)], "text string")
    found = scan_with_index(docs, "text", RuleIndex(python_rule_rows(rows))).collect()
    assert {(r.ord, r.rule_id, r.rule_name, r.severity_rank, r.matched_text) for r in found} == {(7, "own", "own", 2, "12 "), (9, "bare", "bare", 2, "b")}


@pytest.mark.parametrize("size", [0, 1 << 30])
def test_size_of_the_index_decides_on_broadcasting(spark, monkeypatch, size):
    from leaksieve.operators import rule_index

    monkeypatch.setattr(rule_index, "BROADCAST_BYTES", size)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([("acme_1234 and more",)], "text string")
        found = scan_with_index(docs, "text", RuleIndex(rule_rows(spark, RULES)))
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (size > 0)
        assert found.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_of_a_large_index(spark, monkeypatch):
    """An index too large to be broadcast moves lines for its own grams, and gives the same findings."""
    from leaksieve.operators import rule_index

    monkeypatch.setattr(rule_index, "BROADCAST_BYTES", 0)
    test_odd_rules_and_texts(spark)
    rules = RuleSet(()).with_rules(*[Rule(f"r{i}", f"Rule {i}", f"name{i:06d}x", "low", keywords=(f"name{i:06d}x",)) for i in range(3000)])
    index = RuleIndex(rule_rows(spark, rules))
    assert index.table.where(~may_hold(index.table, "gram")).isEmpty()
    others = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("gram"))
    assert others.where(may_hold(index.table, "gram")).count() < 2_000
    docs = spark.range(50).select("id", F.concat(F.repeat(F.lit("some other words of a line "), F.lit(40)), F.lit("name"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("x")).alias("text"))
    found = scan_with_index(docs, "text", index)
    assert found.count() == 50 and "shiftleft" in found._jdf.queryExecution().optimizedPlan().toString()
