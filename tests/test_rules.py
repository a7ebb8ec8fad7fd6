import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leaksieve import Rule, RuleSet, scan_text
from leaksieve.catalogue import LINEAR_FORMS
from leaksieve.functions.regex import is_context_free, to_java
from leaksieve.operators.rollup import rule_counts, rule_listing
from tests.expected import expected_hits
from workload.planted import LINES, line_sql

RULES = RuleSet.builtin()


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def planted(spark):
    row = spark.range(1).select(*[F.expr(line_sql(line, "'42'")).alias(f"c{i}") for i, line in enumerate(LINES)])
    return list(row.first())


def check(spark, values, rules=RULES):
    found = scan_text(texts(spark, values), "text", rules).collect()
    got = {(r.id, r.line_number, r.ord, r.snippet, r.matched_text) for r in found}
    expected = expected_hits(dict(enumerate(values)), rules)
    assert got == expected
    assert len(found) == len(got)
    return got


def test_catalogue():
    assert len(RULES) == 78
    assert len({r.rule_id for r in RULES.rules}) == 78
    by_severity = {}
    for rule in RULES.rules:
        by_severity[rule.severity] = by_severity.get(rule.severity, 0) + 1
    assert by_severity == {"critical": 29, "high": 36, "medium": 11, "low": 2}
    assert sum(not rule.keywords for rule in RULES.rules) == 2


def test_every_rule_fires_on_its_line(spark):
    lines = planted(spark)
    got = check(spark, lines)
    assert {(i, i + 1) for i in range(78)} <= {(h[0], h[2]) for h in got}
    assert len(got) == 84


def test_all_lines_in_one_text(spark):
    assert len(check(spark, ["\n".join(planted(spark))])) == 84


def test_needed_literals_are_in_every_match(spark):
    for line, rule in zip(planted(spark), RULES.rules):
        haystack = line.lower() if rule.ignores_case else line
        assert all(need in haystack for need in rule.needs), rule.rule_id
        if rule.ignores_case:
            assert not re.search("[is]", "".join(rule.needs)), rule.rule_id


def test_truncated_lines_do_not_fire_differently(spark):
    """Planted lines cut or damaged at random: same hits as Python."""
    choose = random.Random(7)
    damaged = []
    for line in planted(spark):
        for _ in range(4):
            at = choose.randrange(len(line))
            damaged.append(line[:at] + choose.choice(["", " ", "\u00e9", "\u00a0", "A", "\x1f", ":"]) + line[at + 1:])
            damaged.append(line[:at])
            damaged.append(line.swapcase())
    check(spark, damaged)


def test_assignments_with_colons(spark):
    """Built-in rules that ignore case, with other operators, blanks, quotes and letter case."""
    lines = [line for line, rule in zip(planted(spark), RULES.rules) if rule.ignores_case]
    changed = [line.replace("=", operator, 1) for line in lines
               for operator in (":", " : ", ":\u00a0\x1f", ":'", ' : "', ":\u2003'", "=", "= ", "='")]
    changed += [line.upper() for line in changed] + [line.replace(": ", "=") for line in lines]
    got = check(spark, changed)
    assert len({h[2] for h in got}) > 20
    check(spark, ["Authorization: BA\u017fIC " + "a" * 12, "bearer :'Bearer\u00a0" + "a" * 20, "x: y", "a=b"])


def test_keywords_are_in_every_match_of_case_sensitive_rules(spark):
    for line, rule in zip(planted(spark), RULES.rules):
        if rule.keywords and not rule.ignores_case:
            found = re.search(rule.pattern, line).group().lower()
            assert any(keyword in found for keyword in rule.keywords), rule.rule_id


def test_registered_rules_see_their_keywords(spark):
    rules = RULES.with_rules(Rule("a", "A", "(?i)needle", "low", keywords=("needle",)),
                             Rule("b", "B", "NEEDLE", "low", keywords=("hay",)))
    check(spark, ["a NEEDLE in prose", "a NEEDLE in Hay", "needle hay"], rules)


@pytest.mark.parametrize("line, rule_id", [
    ("clientsecret=" + "a" * 30, "gcp-oauth-client-secret"),
    ("account-key=" + "a" * 88, "azure-storage-account-key"),
    ("ad_secret=" + "a" * 40, "azure-ad-client-secret"),
    ("do_key=" + "A" * 20, "digitalocean-spaces-key"),
    ("redis_password='abcdefgh'", "database-password-assignment"),
    ("postgres_password='abcdefgh'", "database-password-assignment"),
])
def test_keywords_narrow_rules(spark, line, rule_id):
    rule = next(r for r in RULES.rules if r.rule_id == rule_id)
    assert re.search(rule.pattern, line)
    check(spark, [line])
    assert rule_id not in {r.rule_id for r in scan_text(texts(spark, [line]), "text").collect()}


def test_unicode_follows_python(spark):
    digits = "\u0661" * 13
    got = check(spark, [
        "pa\u017f\u017fword pwd = 'abcdefgh'", "to\u212aen token = 'abcdefgh'", "\u017fecret: 'abcdefgh' secret",
        "token\u00a0=\u2003'abcdefgh'", "token\x1f=\x1f'abcdefgh'", "ap\u0131key = 'abcdefgh' api_key = 'abcdefgh'",
        "AP\u0130KEY 'x' API_\u212aEY = '\u00e1bcdefgh'", "aws_account_id=" + digits[:12], "aws_account_\u0131d=" + digits[:12],
        digits + "-" + "a" * 32 + ".apps.googleusercontent.com",
        "M" + "a1" * 12 + ".\u00e9\u00b2_-x1." + "a" * 20 + "e\u0301bcdefgh", "\u0130D token = 'abcdefgh'",
        "M" + "a\u0661" * 12 + ".\u00e9\u00b2_-x1." + "a" * 30, "http://\u00fcser:p\u00e4ss\u00a0@h/x", "http://u:p\u200b@h\u2009x",
    ])
    assert len({h[0] for h in got}) >= 10


def test_line_boundaries(spark):
    secret = "token = 'abcdefgh'"
    boundaries = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\n\r"]
    got = check(spark, [secret + b + "short" + b + "\u3000" + secret + b for b in boundaries])
    assert len(got) == 2 * len(boundaries)
    check(spark, ["", "\n", secret + "\n\n\n", "token =\n'abcdefgh'", "token = 'abc\ndefgh'"])


def test_null_text(spark):
    assert scan_text(texts(spark, [None, "token = 'abcdefgh'"]), "text").count() == 1


def test_short_lines(spark):
    rules = RULES.with_custom({"x": "x"})
    check(spark, ["xxxxxxx", "xxxxxxxx", "  xxxxxxx  ", "\u2003xxxxxxxx\x1f", "x\U0001f600" * 4, "x\U0001f600" * 3 + "x"], rules)


def test_custom_rules(spark):
    rules = RULES.with_custom([
        ("My Secret", r"MY_SECRET_\d{8}"), ("My Secret", r"MY_SECRET_\d{8}"), ("Anchored", r"^begin .*end$"),
        ("Word", r"\bsecre\w+\b"), ("Named", r"(?P<a_b>x)-(?P=a_b)-x"), ("Class", r"[[&&a-]{3}\s[^\W\d]+"),
        ("Behind", r"(?<!a)bcdefgh"), ("Empty", r"z*"), ("Fold", r"(?i)stra\u00dfe[^\S ]"), ("End", r"tail\Z"),
    ], spark)
    assert rules.rules[78].rule_id == "custom-my-secret" and rules.rules[78].severity == "medium"
    check(spark, [
        "key MY_SECRET_12345678", "key MY_SECRET_" + "\u0661" * 8, "begin x end\nnot begin x end",
        "my secrets, mysecret", "y x-x-x y", "[&a \u00e9_x 1", "abcdefgh\nbcdefgh", "STRASSE stra\u00dfe\tx", "long tail\nlong tail x",
    ], rules)


def test_registered_rules_may_share_ids(spark):
    rules = RULES.with_rules(Rule("generic-token-assignment", "Again", "token", "low"))
    found = scan_text(texts(spark, ["a token = 'abcdefgh'"]), "text", rules).collect()
    assert sorted((r.ord, r.rule_name) for r in found) == [(36, "Hardcoded Token"), (79, "Again")]


def test_bad_custom_regex(spark):
    with pytest.raises(ValueError, match="no regular expression"):
        RULES.with_custom({"bad": "("})
    with pytest.raises(ValueError, match=r"bad: '\(a\)\(\?\(1\)b\|c\)' has no equivalent"):
        RULES.with_custom({"good": "x", "bad": "(a)(?(1)b|c)", "fine": "y"}, spark)
    assert len(RULES.with_custom({}, spark)) == 78


def test_many_custom_rules(spark):
    rules = RULES.with_custom([(f"n{i}", f"custom{i}_[a-z]{{4}}") for i in range(150)], spark)
    got = check(spark, ["a custom7_abcd custom149_abcd", "custom151_abcd", "token = 'abcdefgh'"], rules)
    assert {h[2] for h in got} == {78 + 8, 78 + 150, 36}


def test_summaries(spark):
    frame = RULES.to_frame(spark)
    assert {r.severity: r.n for r in rule_counts(frame).collect()} == {"critical": 29, "high": 36, "medium": 11, "low": 2}
    listing = rule_listing(frame).collect()
    assert [r.ord for r in listing] == list(range(1, 79))
    assert listing[0].severity == "HIGH" and listing[0].description.endswith("…") and len(listing[0].description) == 51


def test_context_free_patterns():
    assert all(map(is_context_free, [r"a+b", r"(?:x|y)\bz", r"[^$]+", r"\^x", r"(?i)a", r"(?P<n>a)"]))
    assert not any(map(is_context_free, [r"^a", r"a$", r"(?=a)", r"(?<!a)b", r"a\Z", r"a++", r"(?>a)", r"\\^", r"\[^a\]", r"a\B", r"[a]^"]))
    assert is_context_free(r"\[a\]") and is_context_free(r"[]^a]+\\")


def test_java_rewrite():
    assert to_java(r"[^\s'\"]") .startswith("[^") and r"\s" not in to_java(r"\s[\s]")
    assert to_java(r"(?i)a") == "(?iu)a"
    assert to_java(r"[[a&&b]") == r"[\[a&\&b]"


PIECES = [*":::@@@/ab'\"< \t=h;\u00a0", "http://", "https://", "export ", "key", "token", "=", "redis://", "rediss://",
          "mongodb+srv://", "1" * 12, "-" + "a" * 32, ".apps.googleusercontent.com", "postgres://", "mysql://"]


def test_linear_forms_equal_the_catalogue(spark):
    rules = [r for r in RULES.rules if r.rule_id in LINEAR_FORMS]
    choose = random.Random(11)
    lines = ["".join(choose.choices(PIECES, k=choose.randrange(30))) for _ in range(40_000)]
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    hits = frame.select("line", *[
        F.when(F.rlike("line", F.lit(r.java_pattern)), F.regexp_extract("line", r.java_pattern, 0)).alias(f"h{i}")
        for i, r in enumerate(rules)]).collect()
    seen = [0] * len(rules)
    for row in hits:
        for i, rule in enumerate(rules):
            found = re.search(rule.pattern, row.line)
            assert row[f"h{i}"] == (found.group() if found else None), (rule.rule_id, row.line)
            seen[i] += bool(found)
    assert min(seen) > 10, dict(zip((r.rule_id for r in rules), seen))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES + ["\n", "\r", "password", "secret", "'abcdefgh'"]), max_size=40)
                .map("".join), min_size=10, max_size=30))
def test_random_texts_match_python(spark, values):
    check(spark, values)


def test_long_lines_take_linear_time(spark):
    import time
    # Warm up, so that only the matching is measured.
    scan_text(texts(spark, ["x http://a:b@c"]), "text").count()
    start = time.time()
    lines = ["http://" + "a:" * 200_000, "x@y http://a:b@" + "c:" * 200_000, "export " + "key" * 100_000 + " a=",
             "1" * 300_000 + " .apps.googleusercontent.com", "M" * 300_000 + ".", "redis://" + ":" * 300_000 + " @"]
    found = scan_text(texts(spark, lines), "text").collect()
    assert {(r.id, r.rule_id) for r in found} == {(1, "url-with-credentials")}
    assert time.time() - start < 20


def test_documents_match_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    expected = expected_hits({r.doc_id: r.text for r in docs.collect()}, RULES)
    found = scan_text(docs, "text").collect()
    assert {(r.doc_id, r.line_number, r.ord, r.snippet, r.matched_text) for r in found} == expected
    assert len(found) == len(expected) == 12
    assert scan_text(docs.limit(0), "text").collect() == []


def test_registered_rules_of_any_category(spark):
    """Rules that are not the catalogue's take no shortcut, whatever category or id they claim."""
    needle = "acme" + "_12345678"
    rules = RuleSet.builtin().with_rules(
        Rule("acme-start", "Start", r"^acme_\d{8}", "high", category="mycorp"),
        Rule("acme-case", "Case", r"(?i)acme: needle", "low", keywords=("acme",), category="mycorp"),
        Rule("acme-gated", "Gated", r"other_\d{4}", "low", keywords=("absent",), category="mycorp"),
        Rule("url-with-credentials", "Own", r"^own-\d{4}:$", "low", category="generic", known=True))
    found = scan_text(texts(spark, [f"first line\n{needle}", "no ACME: Needle here", "other_1234 alone", "own-1234:"]), "text", rules)
    assert {(r.id, r.line_number, r.ord, r.matched_text) for r in found.collect()} == {
        (0, 2, 79, needle), (1, 1, 80, "ACME: Needle"), (3, 1, 82, "own-1234:")}
