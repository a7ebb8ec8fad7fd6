"""The rule matcher as Catalyst expressions.

Two levels. ``candidate_rules`` runs once per text and keeps the rules that can fire somewhere in
it; texts without any are never split into lines. ``line_hits`` then gives the exact per-line
result for the candidates. Both are narrow: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from leaksieve.catalogue import COLON_ASSIGNMENT
from leaksieve.functions.regex import to_java
from leaksieve.rules import Rule, RuleSet

# Literals shared by many rules, for case-sensitive patterns and for the others: one test of the
# literal spares a text all tests of its family.
_FAMILIES = ("_", "-----BEGIN ", "://", "sk-", "xox", "sq0")
_LOWER_FAMILIES = ("key", "token", "ecret", "account", "pass")

# A literal with a digit or punctuation, at least this long, hardly occurs outside secrets.
_DISTINCTIVE_LENGTH = 6

# Candidates are kept as bits of 64-bit words; the sign bit stays free.
_WORD_BITS = 63

# Rules without a family are skipped together in runs of this many.
_RUN = 8

_HITS = "array<struct<ord:int,matched_text:string>>"


def _needs(rule: Rule, text: Column, low: Column) -> list[Column]:
    haystack = low if rule.ignores_case else text
    return [F.contains(haystack, F.lit(literal)) for literal in rule.needs]


def _keyword_gate(rule: Rule, low: Column) -> list[Column]:
    if not rule.keywords or rule.keywords_implied:
        return []
    return [reduce(or_, [F.contains(low, F.lit(k)) for k in rule.keywords])]


def _gates(rule: Rule, text: Column, low: Column) -> list[Column]:
    """Conditions to test before the pattern, literals before regular expressions."""
    probes = [F.rlike(text, F.lit(probe)) for probe in rule.probes]
    return [*_needs(rule, text, low), *_keyword_gate(rule, low), *probes]


def _family(rule: Rule) -> str | None:
    """The family whose literal the rule cannot do without."""
    if not rule.ignores_case:
        return next((f for f in _FAMILIES if any(f in need for need in rule.needs)), None)
    return next((f for f in _LOWER_FAMILIES if any(f in need for need in rule.needs)
                 or rule.keywords and all(f in keyword for keyword in rule.keywords)), None)


def _is_distinctive(rule: Rule) -> bool:
    """Whether a literal of the rule alone all but proves a match, so that the whole text need not be searched."""
    return not rule.ignores_case and any(
        len(need) >= _DISTINCTIVE_LENGTH and not need.isalpha() for need in rule.needs)


def _is_sure(rule: Rule) -> bool:
    return _is_distinctive(rule) or not rule.testable_on_whole_text


def _any_bit(bits: Sequence[Column]) -> Column:
    """Bitwise or as a balanced tree, so that many rules do not nest deeply."""
    if len(bits) == 1:
        return bits[0]
    middle = len(bits) // 2
    return _any_bit(bits[:middle]).bitwiseOR(_any_bit(bits[middle:]))


def _bit(ord_: int) -> tuple[int, Column]:
    word, bit = divmod(ord_ - 1, _WORD_BITS)
    return word, F.lit(1 << bit).cast("long")


_NO_BITS = 0


def lowered(text_name: str, rules: RuleSet) -> Column:
    """The lower-cased text for ``candidate_rules``, empty where no rule can need it.

    The built-in rules that ignore case all look for assignments, which most prose does without.
    (Empty rather than null: a null gate would not keep ``AND`` from evaluating the pattern.)
    """
    text = F.col(text_name)
    if any(not rule.is_builtin and (rule.keywords or rule.needs) for rule in rules.rules):
        return F.lower(text)
    assigns = F.contains(text, F.lit("=")) | F.rlike(text, F.lit(to_java(COLON_ASSIGNMENT)))
    return F.when(assigns, F.lower(text)).otherwise(F.lit(""))


def _words(members: Sequence[tuple[int, Rule, list[Column]]], text: Column, low: Column, n_rules: int) -> list[Column]:
    """The words of bits of the rules whose tests hold, family by family."""
    none = F.lit(_NO_BITS).cast("long")
    families: dict[tuple[int, str | None, bool], list[Column]] = {}
    for ord_, rule, tests in members:
        word, bit = _bit(ord_)
        may_fire = F.when(reduce(and_, tests), bit).otherwise(none) if tests else bit
        families.setdefault((word, _family(rule), rule.ignores_case), []).append(may_fire)
    words = [[none] for _ in range((n_rules - 1) // _WORD_BITS + 1)]
    for (word, literal, ignores_case), bits in families.items():
        found = _any_bit(bits)
        if literal is not None and len(bits) > 1:
            holds = F.contains(low if ignores_case else text, F.lit(literal))
            found = F.when(holds, found).otherwise(none)
        words[word].append(found)
    return [_any_bit(bits) for bits in words]


def _all_bits(n_rules: int) -> list[Column]:
    return [F.lit((1 << min(_WORD_BITS, n_rules - at)) - 1).cast("long") for at in range(0, n_rules, _WORD_BITS)]


@lru_cache(maxsize=64)
def sure_candidates(text_name: str, low_name: str, rules: RuleSet) -> Column:
    """The candidates, as ``candidate_rules`` gives them, that are known without searching the text.

    The first distinctive literal settles that the text is split. All rules are candidates then: their literals are looked for
    in its lines anyway, and looking for each in the whole text before costs as much again.
    """
    text, low = F.col(text_name), F.col(low_name)
    sure = [(ord_, rule, _gates(rule, text, low)) for ord_, rule in rules.numbered() if _is_sure(rule)]
    distinctive = [reduce(and_, tests) for _, rule, tests in sure if _is_distinctive(rule)]
    words = F.array(*_words([m for m in sure if not _is_distinctive(m[1])], text, low, len(rules)))
    if not distinctive:
        return words
    return F.when(reduce(or_, distinctive), F.array(*_all_bits(len(rules)))).otherwise(words)


@lru_cache(maxsize=64)
def candidate_rules(text_name: str, low_name: str, sure_name: str, rules: RuleSet) -> Column:
    """``ARRAY<BIGINT>`` with one bit per rule that may fire on a line of the text.

    ``low_name`` is the column that ``lowered`` gives, ``sure_name`` that of ``sure_candidates``. A
    text with sure candidates is split anyway: it is not searched for the patterns of other rules,
    whose literals are enough to make them candidates.
    """
    text, low, sure = F.col(text_name), F.col(low_name), F.col(sure_name)
    members = [
        (ord_, rule, [*_gates(rule, text, low), has_candidates(sure_name) | F.rlike(text, F.lit(rule.java_pattern))])
        for ord_, rule in rules.numbered() if not _is_sure(rule)]
    words = _words(members, text, low, len(rules))
    settled = reduce(and_, [sure[i] == bits for i, bits in enumerate(_all_bits(len(rules)))], F.lit(True))
    return F.when(settled, sure).otherwise(F.array(*[sure[i].bitwiseOR(word) for i, word in enumerate(words)]))


def has_candidates(candidates_name: str) -> Column:
    return F.exists(candidates_name, lambda word: word != _NO_BITS)


def is_missing(text_name: str) -> Column:
    """Whether the text is null, as a higher-order function, which whole-stage generation leaves out.

    Next to ``sure_candidates`` in a projection it keeps Spark from generating all rules as part of one
    method, too large for the JIT compiler; a projection generated by itself is cut into small methods.
    """
    return F.exists(F.array(F.isnull(text_name)), lambda null: null)


def _groups(rules: RuleSet) -> list[tuple[str | None, list[tuple[int, Rule]]]]:
    """Rules to skip together on a line: those of one family, the others in runs of a few."""
    groups: dict[tuple, list[tuple[int, Rule]]] = {}
    for ord_, rule in rules.numbered():
        family = _family(rule)
        key = (family, rule.ignores_case) if family else (None, (ord_ - 1) // _RUN)
        groups.setdefault((key, rule.matches_empty), []).append((ord_, rule))
    return [(key[0], members) for (key, _), members in groups.items()]


def _any_candidate(candidates_name: str, members: Sequence[tuple[int, Rule]]) -> Column:
    masks: dict[int, int] = {}
    for ord_, _ in members:
        word, bit = divmod(ord_ - 1, _WORD_BITS)
        masks[word] = masks.get(word, 0) | 1 << bit
    return reduce(or_, [F.col(candidates_name)[word].bitwiseAND(F.lit(mask).cast("long")) != _NO_BITS
                        for word, mask in masks.items()])


@lru_cache(maxsize=64)
def line_hits(line_name: str, low_name: str, candidates_name: str, rules: RuleSet) -> Column:
    """``ARRAY<STRUCT<ord, matched_text>>`` of the first hits of the candidate rules on the line; ``fired`` tells those that are hits.

    No function with a lambda stands around the rules: Spark interprets all below one, and generates code for the rest.
    """
    line, low = F.col(line_name), F.col(low_name)
    parts = []
    for literal, members in _groups(rules):
        hits = []
        for ord_, rule in members:
            word, bit = _bit(ord_)
            tests = [F.col(candidates_name)[word].bitwiseAND(bit) != _NO_BITS, *_gates(rule, line, low)]
            if rule.matches_empty:
                tests.append(F.rlike(line, F.lit(rule.java_pattern)))
            first = F.regexp_extract(line, rule.java_pattern, 0)
            hits.append(F.when(reduce(and_, tests), F.struct(F.lit(ord_).alias("ord"), first.alias("matched_text"))))
        found = F.array(*hits)
        worth_testing = _any_candidate(candidates_name, members)
        if literal is not None:
            worth_testing = worth_testing & F.contains(low if members[0][1].ignores_case else line, F.lit(literal))
        parts.append(F.when(worth_testing, found).otherwise(F.array().cast(_HITS)))
    return F.concat(*parts)


def fired(hits_name: str, rules: RuleSet) -> Column:
    """The hits among the entries of ``line_hits``, null where there is no entry."""
    # A pattern that cannot match the empty text gives it only where there is no match.
    empty = [ord_ for ord_, rule in rules.numbered() if rule.matches_empty]
    return F.when(F.size(hits_name) > 0, F.filter(
        hits_name, lambda hit: hit.isNotNull() & ((hit["matched_text"] != "") | (hit["ord"].isin(empty) if empty else F.lit(False)))))
