import pytest
from pyspark.errors import AnalysisException

from leaksieve.functions.text import MIN_LINE_LENGTH, WHITESPACE
from leaksieve.plans.functions import _BOUNDARY, _Matcher, register_functions
from leaksieve.plans.scan import scan_text
from leaksieve.rules import Rule, RuleSet
from workload.planted import LINES, line_sql
from workload.tables import table

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted(map(repr, frame.select(*columns).collect()))


def test_findings_are_those_of_scan_text(spark):
    docs = table(spark, SF, "planted_conversations").select("conv_id", "text", "turn")
    docs.createOrReplaceTempView("planted")
    register_functions(spark)
    found = spark.sql("SELECT * FROM scan_text(TABLE(planted), 'text')")
    expected = scan_text(docs, "text")
    assert set(found.columns) == set(expected.columns)
    assert rows(found, expected.columns) == rows(expected, expected.columns)
    assert "Exchange" not in found.select("conv_id")._jdf.queryExecution().executedPlan().toString()


def test_own_rules_and_odd_texts(spark):
    rules = RuleSet(()).with_rules(Rule("own", "Own", r"^acme_\d+|$", "high", "d", keywords=("acme",)), Rule("any", "Any", r"(?i)KEY\s", "low"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ACME and\x85 Key here\r\nacme_12 key "), (4, "key"), (5, "a key is key\ttoo")], "id long, body string")
    docs.createOrReplaceTempView("odd")
    register_functions(spark, rules, "scan_own")
    found, expected = spark.sql("SELECT * FROM scan_own(TABLE(odd), 'body')"), scan_text(docs, "body", rules)
    assert rows(found, expected.columns) == rows(expected, expected.columns) and expected.count() >= 4
    counted = spark.sql("SELECT id, count(*) AS n FROM scan_own(TABLE(SELECT * FROM odd WHERE id > 3) PARTITION BY (id), 'body') GROUP BY id")
    assert {(r.id, r.n) for r in counted.collect()} == {(i, n) for i, n in [(r.id, r["count"]) for r in expected.where("id > 3").groupBy("id").count().collect()]}


def test_lines_are_not_tested_rule_by_rule(spark, monkeypatch):
    planted = spark.sql("SELECT array(" + ", ".join(line_sql(line, "'12'") for line in LINES) + ") AS lines").first().lines
    own = [Rule("empty", "Empty", "x", "low", needs=("",)), Rule("broken", "Broken", "key", "low", needs=("key\n",)), Rule("any", "Any", r"\d{9}|\u0130", "low"),
           Rule("either", "Either", r"(?i)i\u0307?x", "low", keywords=("i\u0307x", "key"))]
    text = "\u0130x and \u03a3\u03a3 \x0b" + "\r\n".join(planted) + "\x85no secret\n\nkey" + "\u2028".join(reversed(planted)) + "\n"
    matcher = _Matcher(RuleSet.builtin().with_rules(*own))
    expected = []
    for number, line in enumerate(_BOUNDARY.split(text), 1):
        snippet = line.strip(WHITESPACE)
        for _, rule, pattern, attributes in matcher.rules if len(snippet) >= MIN_LINE_LENGTH else ():
            if matcher._may_fire(rule, line, line.lower()) and (match := pattern.search(line)):
                expected.append((number, *attributes, snippet, match[0], rule.description))
    calls, may_fire = [], _Matcher._may_fire
    monkeypatch.setattr(_Matcher, "_may_fire", staticmethod(lambda rule, *held: calls.append(rule) or may_fire(rule, *held)))
    assert list(matcher.findings(text)) == expected and len(expected) > 2 * len(LINES)
    assert len(calls) <= len(matcher.rules)


@pytest.mark.parametrize("call, message", [
    ("TABLE(odd), 'nothing'", "must name the column"), ("TABLE(odd), 'id'", "no string column"), ("TABLE(clash), 'body'", "named like results")])
def test_arguments_are_checked(spark, call, message):
    spark.createDataFrame([(1, "x")], "id long, body string").createOrReplaceTempView("odd")
    spark.createDataFrame([(1, "x")], "ord long, body string").createOrReplaceTempView("clash")
    register_functions(spark)
    with pytest.raises(AnalysisException, match=message):
        spark.sql(f"SELECT * FROM scan_text({call})")
