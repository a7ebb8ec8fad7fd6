"""Deletes passages of lines that stand in an earlier document, or earlier in the same one, by winnowing.

Lines are compared by their words; lines without a word are no part of a passage. A *gram* is a run of lines
with at least ``GRAM_WORDS`` words that is the shortest such run from its first line or up to its last one; a *window* is the
same with ``GUARANTEE`` words. Of the grams within a window the one with the smallest hash is its fingerprint. Whether a run is a
gram or a window, and which gram is chosen, is decided by the lines of the window alone. So equal windows have one
fingerprint, and documents that share a window share a fingerprint, although few of all grams are kept.

How it runs:

1. One pass over the texts gives each document's fingerprints, each once, and its windows with the fingerprint, first and last
   line of each, without texts. Grams and windows that repeat within a document are marked at once.
2. A rollup with partial sums counts the documents of each fingerprint; those of more than one are matches, and are joined
   back to the documents that hold them.
3. A match is extended both ways, line by line, to all windows that chose the fingerprint: a second rollup gives each
   window's first document, whichever that is, and the window is joined back to the later ones.
4. Windows that stand earlier cover the runs that are deleted: as each line of a passage of ``GUARANTEE`` words lies in a window within
   the passage, such a passage goes whole, wherever and however often its parts stand otherwise.

There is one row per document and shared fingerprint or window, never the pairs of a group; rows of one that very many
documents hold are joined in parts.

Order: ``doc_id`` (null last), then the row's place in the input; the earliest copy of a line stays.

Defined results: a null text stays null and an empty one empty; a passage of fewer than ``GUARANTEE`` words stays in each
document (one of ``GRAM_WORDS`` words goes where it repeats within a document); of repeated rows the first keeps its text;
blank lines go with the line before them; other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leaksieve.llm.arrays import blocks, buffers, mix, signed, words
from leaksieve.llm.shared import discard, free_name, python_ready, tidy, written

GRAM_WORDS = 25
GUARANTEE = 50
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of one fingerprint or window that are joined in one part, at least.
PART_ROWS = 1 << 12
_WINDOWS = "windows array<long>, chosen array<long>, begins array<int>, stops array<int>"
_LINED = f"key long, doc_id long, n_lines int, at array<int>, gone binary, prints array<long>, {_WINDOWS}"


def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, inverse))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts, for each line with a word: its hash, words and number; where each text's begin; lines in each text."""
    base = int(offsets[0])
    newlines = np.flatnonzero(data[base:int(offsets[-1])] == 10) + base
    before = np.searchsorted(newlines, offsets)
    n_lines = np.diff(before) + 1
    hashes, bounds, first = words(data, offsets)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return hashes, none, none, np.zeros(len(offsets), np.int64), n_lines
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = np.searchsorted(newlines, bounds[:, 0]) - before[text]
    begins = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (number[1:] != number[:-1])))
    sizes = np.diff(np.append(begins, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(begins, sizes)
    line = mix(np.add.reduceat(mix(hashes + place.astype(np.uint64) * _ODD), begins))
    return line, sizes, number[begins], np.searchsorted(begins, first), n_lines


def runs_of(line: np.ndarray, sizes: np.ndarray, first: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of at least ``n_words`` words that are shortest from their first or up to their last line.

    Of each, ordered by its first line: its hash, its first line, and the line behind its last.
    """
    n = np.diff(first)
    start, stop = np.repeat(first[:-1], n), np.repeat(first[1:], n)
    total = np.concatenate([[0], np.cumsum(sizes)])
    end = np.searchsorted(total, total[:-1] + n_words)
    begin = np.searchsorted(total, total[1:] - n_words, side="right") - 1
    at, last = np.flatnonzero(end <= stop), np.flatnonzero(begin >= start)
    # Runs that are the shortest both ways are taken once.
    last = last[end[begin[last]] != last + 1]
    begins, ends = np.concatenate([at, begin[last]]), np.concatenate([end[at], last + 1])
    order = np.lexsort((ends, begins))
    begins, ends = begins[order], ends[order]
    power, inverse = _odd_powers(len(line))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * power[:-1], dtype=np.uint64)])
    return mix((sums[ends] - sums[begins]) * inverse[begins]), begins, ends


def winnow(grams: tuple[np.ndarray, np.ndarray, np.ndarray], begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The smallest hash of the grams within each window."""
    gram, first, stop = grams
    least = np.full(len(begins), np.uint64(0xFFFFFFFFFFFFFFFF))
    live, at = np.arange(len(begins)), np.searchsorted(first, begins)
    while len(live):
        inside = at < len(gram)
        live, at = live[inside], at[inside]
        inside = first[at] < ends[live]
        live, at = live[inside], at[inside]
        whole = stop[at] <= ends[live]
        least[live[whole]] = np.minimum(least[live[whole]], gram[at[whole]])
        at = at + 1
    return least


def _again(run: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which runs stood earlier in the same text."""
    order = np.lexsort((run, owner))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (run[order][1:] == run[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return again


def _cover(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n lines a range covers."""
    steps = np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in blocks(offsets):
            line, sizes, number, first, n_lines = lines_of(data, offsets[a:b + 1])
            text = np.repeat(np.arange(b - a), np.diff(first))
            grams = runs_of(line, sizes, first, GRAM_WORDS)
            again = _again(grams[0], text[grams[1]])
            gone = _cover(grams[1][again], grams[2][again], len(line))
            # A window that repeats within a text is made of repeated grams.
            window, begins, ends = runs_of(line, sizes, first, GUARANTEE)
            chosen = winnow(grams, begins, ends)
            fresh = ~_again(window, text[begins])
            window, begins, ends, chosen = window[fresh], begins[fresh], ends[fresh], chosen[fresh]
            owner = text[begins]
            order = np.lexsort((chosen, owner))
            prints = order[~_again(chosen, owner)[order]]
            window_first = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
            print_first = np.searchsorted(owner[prints], np.arange(b - a + 1)).astype(np.int32)
            marks = gone.astype(np.uint8).tobytes()

            def lists(begin: np.ndarray, values: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(begin), pa.array(values))

            yield pa.record_batch({
                "key": batch.column("key").slice(a, b - a), "doc_id": batch.column("doc_id").slice(a, b - a),
                "n_lines": pa.array(n_lines.astype(np.int32)), "at": lists(first.astype(np.int32), number.astype(np.int32)),
                "gone": pa.array([marks[x:y] for x, y in zip(first[:-1], first[1:])], pa.binary()),
                "prints": lists(print_first, signed(chosen[prints])), "windows": lists(window_first, signed(window)),
                "chosen": lists(window_first, signed(chosen)), "begins": lists(window_first, (begins - first[owner]).astype(np.int32)),
                "stops": lists(window_first, (ends - first[owner]).astype(np.int32))})


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every line of a text, blank ones included, whether it goes."""
    for batch in batches:
        found, gone_lines = [], []
        for row in batch.to_pylist():
            gone = np.frombuffer(row["gone"], np.uint8).astype(bool)
            if row["runs"]:
                runs = np.array([(r["begin"], r["stop"]) for r in row["runs"]])
                gone = gone | _cover(runs[:, 0], runs[:, 1], len(gone))
            # A blank line goes with the line before it.
            owner = np.searchsorted(np.array(row["at"]), np.arange(row["n_lines"]), side="right") - 1
            mask = np.where(owner >= 0, gone[np.maximum(owner, 0)], False)
            found.append(mask)
            gone_lines.append(int(gone.sum()))
        sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield pa.record_batch({
            "key": batch.column("key"), "n_removed": pa.array(gone_lines, pa.int32()), "n_left": pa.array(
                [len(r) - g for r, g in zip(batch.column("at").to_pylist(), gone_lines)], pa.int32()),
            "mask": pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found)))})


def _join_back(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """``rows`` joined to the written ``table`` (``on``, ``n`` rows with it, more), those of a frequent value in parts.

    Fewer than 1,024 values have more than a 1,024th of all rows; only their numbers are collected. Both sides are shuffled at
    every size, as either grows with the input.
    """
    limit = max(PART_ROWS, (table.agg(F.sum("n")).first()[0] or 0) >> 10)
    many = table.where(F.col("n") > limit).select(on, F.ceil(F.col("n") / limit).cast("long").alias("parts")).collect()
    many = F.broadcast(table.sparkSession.createDataFrame(many, f"{on} long, parts long"))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(many, on, "left").withColumn("part", F.pmod("key", parts)).drop("parts")
    table = table.join(many, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts", "n")
    return rows.join(table.hint("merge"), [on, "part"]).drop("part")


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """``(key, n_removed, n_left, mask)`` of the rows of ``keyed`` (key, doc_id, text) that lose a line."""
    lined = written(python_ready(keyed).select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                    .mapInArrow(tidy(_lined), _LINED))
    prints = lined.select("key", F.explode("prints").alias("print"))
    shared = written(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"))
    matched = _join_back(prints, shared, "print").groupBy("key").agg(F.collect_list("print").alias("matched"))
    holders = lined.select("key", "doc_id", "windows", "chosen", "begins", "stops").join(matched.hint("merge"), "key")
    windows = written(holders.select("key", "doc_id", "matched", F.explode(F.arrays_zip("windows", "chosen", "begins", "stops")).alias("w")).where(
        F.array_contains("matched", F.col("w.chosen"))).select(
        "key", "doc_id", F.col("w.windows").alias("window"), F.col("w.begins").alias("begin"), F.col("w.stops").alias("stop")))
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    firsts = written(windows.groupBy("window").agg(F.min(who)["key"].alias("first_key"), F.count("*").alias("n")).where("n > 1"))
    matches = _join_back(windows.select("key", "window", "begin", "stop"), firsts, "window")
    runs = matches.where("key <> first_key").groupBy("key").agg(F.collect_list(F.struct("begin", "stop")).alias("runs"))
    marked = lined.select("key", "n_lines", "at", "gone").join(runs, "key", "left").where(
        F.col("runs").isNotNull() | F.col("gone").contains(F.lit(b"\x01")))
    masks = written(marked.mapInArrow(_masks, "key long, n_removed int, n_left int, mask array<boolean>"))
    discard(lined, shared, windows, firsts)
    return masks


def _without_lines(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs`` with its texts shortened, and the names of its added columns: row key, lines removed, lines left (null: none removed)."""
    key, mask, removed, left = (free_name(docs, x) for x in ("_key", "_mask", "_removed", "_left"))
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()))
    found = repeated_lines(keyed.select(F.col(key).alias("key"), "doc_id", "text")).select(
        F.col("key").alias(key), F.col("n_removed").alias(removed), F.col("n_left").alias(left), F.col("mask").alias(mask))
    # One plan for all sizes: the masks grow with the table, so that a broadcast of them would hold for small tables only.
    joined = keyed.join(found.hint("merge"), key, "left")
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.get(F.col(mask), i))
    return joined.withColumn("text", F.when(F.col(mask).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))).drop(mask), key, removed, left


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_removed, text)`` for every row of ``docs`` (doc_id, text): its text without the repeated passages."""
    found, _, removed, _ = _without_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", F.coalesce(F.col(removed), F.lit(0)).cast("long").alias("n_removed"), "text")


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with shortened texts (and ``n_chars``, if there); rows that lost all their words go."""
    found, key, removed, left = _without_lines(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return found.where(F.col(left).isNull() | (F.col(left) > 0)).select(*docs.columns)
