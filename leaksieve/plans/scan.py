"""From texts to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leaksieve.functions.redact import redact_all
from leaksieve.functions.text import long_enough, split_lines, strip
from leaksieve.operators.match import candidate_rules, fired, has_candidates, is_missing, line_hits, lowered, sure_candidates
from leaksieve.plans.partitioning import dealt
from leaksieve.rules import RuleSet

RESULT_COLUMNS = {"line_number", "ord", "rule_id", "rule_name", "severity", "severity_rank", "snippet",
                  "masked_snippet", "matched_text", "description"}


def find_hits(df: DataFrame, text: str, rules: RuleSet, *, added_lines_only: bool = False,
              keep_plus_plus: bool = False, partitions: int | None = None, passing: str | None = None) -> DataFrame:
    """One row per (line, rule) hit: the other columns of ``df`` plus line_number, snippet,
    masked_snippet (every match of the line masked), ord and matched_text.

    With ``added_lines_only`` the text is a patch: lines starting with ``+`` are scanned without it,
    and lines starting with ``+++`` are left out unless ``keep_plus_plus``. ``partitions`` deals the
    input out anew; without it nothing is shuffled. ``passing`` names a boolean column: a row where it holds is not
    searched but passed on once, with nulls for the result, so that one read of the input can serve more than findings.
    """
    taken = sorted(set(df.columns) & RESULT_COLUMNS - {text})
    if taken:
        raise ValueError(f"Columns of the input are named like results: {taken}")
    df = dealt(df, partitions)
    keep = [F.col(f"`{c}`") for c in df.columns if c != text]
    col = F.col
    texts = df.select(*keep, col(f"`{text}`").alias("__text"))
    texts = texts.select(*keep, "__text", lowered("__text", rules).alias("__low"))
    texts = texts.select(*keep, "__text", "__low", sure_candidates("__text", "__low", rules).alias("__sure"),
                         is_missing("__text").alias("__missing"))
    texts = texts.select(*keep, "__text", "__missing",
                         candidate_rules("__text", "__low", "__sure", rules).alias("__rules"))
    pieces = F.when(~col("__missing") & has_candidates("__rules"), split_lines(col("__text")))
    worth = long_enough(col("__line"))
    if passing is not None:
        passed = col(f"`{passing}`")
        pieces, worth = F.when(passed, F.array(F.lit(None).cast("string"))).otherwise(pieces), passed | worth
    lines = texts.select(*keep, "__rules", F.posexplode(pieces).alias("__pos", "__line"))
    if added_lines_only:
        lines = _added(lines, keep_plus_plus)
    lines = lines.where(worth)
    lines = lines.select(*keep, "__rules", "__pos", "__line", F.lower("__line").alias("__low"))
    hits = lines.select(*keep, "__pos", "__line", line_hits("__line", "__low", "__rules", rules).alias("__entries"),
                        is_missing("__line").alias("__missing"))
    hits = hits.select(*keep, "__pos", "__line", F.when(~col("__missing"), fired("__entries", rules)).alias("__hits"))
    # Exploding the bare column would let Catalyst infer a filter on its size and push it below the
    # projection, which evaluates all rules twice.
    each = F.filter("__hits", lambda hit: hit["ord"] > 0)
    number = col("__pos") + 1
    if passing is not None:
        none = F.array(F.struct(F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("matched_text")))
        each, number = F.when(passed, none).otherwise(each), F.when(~passed, number)
    # A line is masked once, whatever its number of hits.
    masked = F.when(F.size("__hits") > 0, strip(redact_all(col("__line"), col("__hits.matched_text"))))
    hits = hits.select(*keep, "__pos", "__line", "__hits", masked.alias("__masked"))
    hits = hits.select(*keep, "__pos", "__line", "__masked", F.explode(each).alias("__hit"))
    return hits.select(
        *keep, number.alias("line_number"), strip(col("__line")).alias("snippet"),
        col("__masked").alias("masked_snippet"),
        col("__hit.ord").alias("ord"), col("__hit.matched_text").alias("matched_text"))


def _added(lines: DataFrame, keep_plus_plus: bool) -> DataFrame:
    line = F.col("__line")
    added = line.startswith("+")
    if not keep_plus_plus:
        added = added & ~line.startswith("+++")
    return lines.where(added).withColumn("__line", F.substring("__line", 2, 2**31 - 1))


def attach_rules(hits: DataFrame, rules: RuleSet, how: str = "inner") -> DataFrame:
    """Adds rule_id, rule_name, severity, severity_rank and description by ``ord``; ``left`` keeps rows without one.

    The rule table is a local relation, so Catalyst knows its size and broadcasts it only when small.
    """
    attributes = rules.to_frame(hits.sparkSession).select(
        "ord", "rule_id", "rule_name", "severity", "severity_rank", "description")
    return hits.join(attributes, "ord", how)


def scan_text(df: DataFrame, text: str, rules: RuleSet | None = None, *, partitions: int | None = None) -> DataFrame:
    """Findings of every text in ``df``, batch or streaming; all other columns are carried along."""
    rules = rules or RuleSet.builtin()
    found = attach_rules(find_hits(df, text, rules, partitions=partitions), rules)
    keep = [F.col(f"`{c}`") for c in df.columns if c != text]
    return found.select(*keep, "line_number", "ord", "rule_id", "rule_name", "severity", "severity_rank",
                        "snippet", "matched_text", "description")
