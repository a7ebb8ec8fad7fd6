"""Small tables with the cases every operator has to bear."""

from __future__ import annotations

import random
import re

LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60000))
PASSAGE = "\n".join(" ".join(f"p{i}q{j}" for j in range(12)) for i in range(6))
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(f"[^{SPACES}]+", text)


def odd_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, score, key): nulls, empty and long texts, copies, repeated rows, odd signs."""
    rng = random.Random(3)
    body = [" ".join(rng.choice(["the", "of", "a", "rain", "stone", "river", "Hill", "walks", "über", "naïve"]) for _ in range(80)) for _ in range(6)]
    texts = [
        None, "", "   \n\t ", "one", "one two three", "one two three four", LONG, body[0], body[0], body[1], body[1] + " end",
        body[2] + "\n" + PASSAGE, PASSAGE + "\n" + body[3], body[4] + "\n" + PASSAGE + "\n\n" + body[5],
        "!!! *** &&& |||\n\n***", "x" * 5000, "İstanbul ΣΑΣ é <|endoftext|>tail<|startoftext|> it's 12345 \x1cend", "\U0001F600 emoji wide",
        "same line here\n" * 40, "A B c D e F g", "a b C d E f G",
    ]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), 0.5, "k") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, body[0], None, None, 7, None, None), (None, None, None, None, None, None, None)]
    return rows


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def odd_frame(spark):
    return spark.createDataFrame(odd_documents(), ODD_SCHEMA)


def empty_frame(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
