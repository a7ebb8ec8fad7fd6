"""Python regular expressions rewritten for java.util.regex, which Spark evaluates.

Python matches ``\\s \\d \\w`` and ``(?i)`` over Unicode; Java does so only when told.
"""

from __future__ import annotations

import re

# Inner parts of a Java character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"

_SHORTHAND = {"s": SPACE, "d": DIGIT, "w": WORD}
_TOKEN = re.compile(
    r"\\.|\[\^?\]?|\]|&&|\(\?P<(?P<name>\w+)>|\(\?P=(?P<ref>\w+)\)|\(\?(?P<flags>[aiLmsux]+)(?P<end>[):])",
    re.DOTALL,
)


def _group_name(name: str) -> str:
    return "g" + name.replace("_", "0x5f")


def to_java(pattern: str) -> str:
    """The Java pattern that matches what ``pattern`` matches in Python."""
    in_class = False

    def rewrite(token: re.Match) -> str:
        nonlocal in_class
        text = token.group()
        if text[0] == "\\":
            kind = text[1]
            inner = _SHORTHAND.get(kind.lower())
            if inner:
                if kind.isupper():
                    return f"[^{inner}]"
                return inner if in_class else f"[{inner}]"
            if kind == "b" and not in_class:
                return r"(?U:\b)"
            return r"\z" if kind == "Z" else text
        if in_class:
            if text == "]":
                in_class = False
                return text
            return text.replace("[", r"\[").replace("]", r"\]").replace("&&", r"&\&")
        if text[0] == "[":
            in_class = True
            return text.replace("]", r"\]")
        if token["name"]:
            return f"(?<{_group_name(token['name'])}>"
        if token["ref"]:
            return rf"\k<{_group_name(token['ref'])}>"
        if token["flags"]:
            flags = "".join(f for f in token["flags"] if f in "imsx")
            flags = flags.replace("i", "iu")
            return f"(?{flags}{token['end']}" if flags else ("(?:" if token["end"] == ":" else "")
        return text

    return _TOKEN.sub(rewrite, pattern)


# Anchors, lookaround, atomic groups and possessive loops see beyond the matched text.
_CONTEXT = re.compile(r"[\^$]|\\[AZzGB]|\(\?[=!<>(]|[*+?}]\+")
_ATOM = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL)


def is_context_free(pattern: str) -> bool:
    """Whether a match inside a line stays a match in any longer text that holds the line."""
    bare = _ATOM.sub(lambda atom: atom.group() if atom.group()[1:] in tuple("AZzGB") else "x", pattern)
    return not _CONTEXT.search(bare)
