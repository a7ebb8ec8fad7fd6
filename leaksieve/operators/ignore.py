"""gitignore patterns as one Catalyst expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import groupby

from pyspark.sql import Column, functions as F

_GLOB = re.compile(r"\\.|\[[!^]?\]?(?:\\.|[^\]])*\]|\*+|\?|.", re.DOTALL)


def parse_ignore_lines(lines: Iterable[str]) -> list[str]:
    """The patterns among the lines of an ignore file."""
    return [p for p in (line.strip() for line in lines) if p and not p.startswith("#")]


def _segment(glob: str) -> str:
    out = []
    for token in _GLOB.findall(glob):
        if token[0] == "*":
            out.append("[^/]*")
        elif token == "?":
            out.append("[^/]")
        elif token[0] == "[" and len(token) > 1:
            body = token[1:-1].replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"(?!/)[{'^' + body[1:] if body[0] in '!^' else body}]")
        else:
            out.append(re.escape(token[-1]))
    return "".join(out)


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """The regex over relative paths and whether it ignores (or, with ``!``, re-includes).

    A pattern without an inner slash matches at any depth; one that matches a directory covers
    everything below it.
    """
    pattern = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not pattern or pattern.startswith("#"):
        return None
    ignores = not pattern.startswith("!")
    body = pattern if ignores else pattern[1:]
    directory_only = body.endswith("/")
    body = body.rstrip("/") if directory_only else body
    if not body:
        return None
    anchored = "/" in body
    parts = body.lstrip("/").split("/") if body.startswith("/") else body.split("/")
    if not anchored:
        parts = ["**", *parts]
    regex = ""
    last = len(parts) - 1
    for i, part in enumerate(parts):
        if part == "**":
            if i == last:
                regex += ".+"
            elif i == 0 or parts[i - 1] != "**":
                regex += "(?:.+/)?"
            continue
        regex += "[^/]+" if part == "*" else _segment(part)
        if i < last:
            regex += "/"
    if parts[-1] == "**":
        tail = "/.*" if directory_only else ""
    else:
        tail = "/.*" if directory_only else "(?:/.*)?"
    return f"^{regex}{tail}$", ignores


def is_ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the last matching pattern ignores the path."""
    regexes = [r for r in map(ignore_regex, patterns) if r]
    decided = []
    for ignores, run in groupby(reversed(regexes), key=lambda r: r[1]):
        matches = F.rlike(path, F.lit("|".join(regex for regex, _ in run)))
        decided.append(F.when(matches, F.lit(ignores)))
    return F.coalesce(*decided, F.lit(False))
