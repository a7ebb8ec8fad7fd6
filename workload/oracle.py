"""Scans written as plain SQL for DuckDB, independent of the Spark plan."""

from __future__ import annotations

from collections.abc import Sequence

from leaksieve.functions.text import MIN_LINE_LENGTH, WHITESPACE
from leaksieve.rules import RuleSet, SEVERITY_RANK

_BOUNDARY = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# RE2 has no lookaround: the same rules with the delimiters consumed, and the group to keep.
_DELIMITED = {
    "aws-access-key-id": (r"(^|[^A-Z0-9])(AKIA[0-9A-Z]{16})($|[^A-Z0-9])", 2),
    "alibaba-access-key-id": (r"(^|[^A-Z0-9])(LTAI[A-Za-z0-9]{20})($|[^A-Za-z0-9])", 2),
}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WHITESPACE_SQL = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def _lines(source: str, ids: Sequence[str], added: bool) -> str:
    keys = ", ".join(ids)
    line, kept = "line", ""
    if added:
        line, kept = "substr(line, 2)", "WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')"
    return f"""
    pieces AS (SELECT {keys}, regexp_split_to_array(text, {quote(_BOUNDARY)}) AS parts FROM {source}),
    raw_lines AS (SELECT {keys}, unnest(parts) AS line, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_number
                  FROM pieces),
    lines AS (SELECT {keys}, line_number, {line} AS line, trim({line}, {WHITESPACE_SQL}) AS snippet,
                     lower({line}) AS low FROM raw_lines {kept}),
    long_lines AS MATERIALIZED (SELECT * FROM lines WHERE length(snippet) >= {MIN_LINE_LENGTH})"""


def scan_ctes(source: str, ids: Sequence[str], rules: RuleSet | None = None, added: bool = False) -> str:
    """CTEs ending in ``found``: the ids, line_number, line, snippet, ord, rule attributes and matched_text."""
    branches = []
    for ord_, rule in (rules or RuleSet.builtin()).numbered():
        pattern, group = _DELIMITED.get(rule.rule_id, (rule.pattern, 0))
        gate = " OR ".join(f"contains(low, {quote(k)})" for k in rule.keywords) or "true"
        branches.append(
            f"SELECT {', '.join(ids)}, line_number, line, snippet, CAST({ord_} AS INTEGER) AS ord, {quote(rule.rule_id)} AS rule_id, "
            f"{quote(rule.name)} AS rule_name, {quote(rule.severity)} AS severity, "
            f"CAST({SEVERITY_RANK[rule.severity]} AS INTEGER) AS severity_rank, {quote(rule.description)} AS description, "
            f"regexp_extract(line, {quote(pattern)}, {group}) AS matched_text FROM long_lines "
            f"WHERE ({gate}) AND regexp_matches(line, {quote(pattern)})")
    union = "\n    UNION ALL ".join(branches)
    return f"{_lines(source, ids, added)},\n    found AS (\n    {union})"


def scan_sql(source: str, ids: Sequence[str], select: str, rules: RuleSet | None = None, added: bool = False,
             more: str = "") -> str:
    return f"WITH {scan_ctes(source, ids, rules, added)}{more}\n{select}"


def rules_values(rules: RuleSet) -> str:
    rows = ", ".join(
        f"({i}, {quote(r.rule_id)}, {quote(r.name)}, {quote(r.severity)}, {quote(r.description)})"
        for i, r in rules.numbered())
    return f"(VALUES {rows}) AS rules(ord, rule_id, rule_name, severity, description)"
