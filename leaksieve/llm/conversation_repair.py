"""Cheapest repair of damaged conversations, by a square-root checkpointed dynamic program.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``: at most one system row, then user and
assistant by turns. Rows are kept (cost 0), get another role, ``user`` or ``assistant`` (2), or are deleted (3; blank rows
and repeats must be), and empty rows of a user or an assistant may be inserted anywhere (2). A truncated row that
stays costs 1 more. Of the cheapest series of edits the one whose initials (``D``, ``I``, ``K``, ``R``) come
first in ASCII order is taken.

Four states of the pattern (nothing yet, after ``s``, after ``u``, after ``a``) make the program: a backward vector holds the
least cost to finish from each state. How it is spread:

1. Rows are sorted into ranges and numbered; a row becomes one letter, its role's initial and its fault. Repeats
   are found by the least number of each conversation, role and text hash (SHA-256).
2. Letters are cut into blocks of at most the square root of all rows, of one conversation each. A block has a 4 x 4 matrix
   of least costs from its first place to its end.
3. Matrices of a conversation are applied from the last to the first. Only the vectors at the ends of blocks, the
   checkpoints, are stored: a conversation of n rows has no more of them than the square root of all rows and one per range.
4. Every block is computed again from its checkpoint while walking forward, and the walk takes the least tight
   edit at each step. Where a conversation has several blocks, a walk from each of the four states first tells through which
   states the conversation goes.
5. Rows meet the edits of their block in the order of their numbers and leave as repaired rows.

A conversation that holds a third of all rows is thus spread over many tasks by ranges of its turns; only the hash of its
whole text is computed in one place, from the pieces of its blocks as they come.

Defined results: nulls in role and text are one space (as is a null in the string that decides the damage), which is a blank
text and a role that is never kept. A null ``conv_id`` is one conversation. Rows go by turn, nulls first, those of one turn by
role and text; equal rows are adjacent. Turns that all are null have no gaps. An empty role has no initial and
is never kept. An empty table gives an empty result. Columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are not read, so
they may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leaksieve.llm.shared import python_ready, tidy, written

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"

#: Blocks have at least this many rows, whatever the number of all rows.
MIN_BLOCK = 1024

Vector = tuple[float, float, float, float]

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_OTHER = 3  # the code of an initial that is none of s, u, a
_WHOLE, _BLANK, _REPEAT, _CUT = range(4)
_NEVER = float("inf")

# States by role code (s, u, a, other) from each state, and the state that an inserted or renamed row leads to.
_KEPT = ((_SYSTEM, _USER, None, None), (None, _USER, None, None), (None, None, _ASSISTANT, None), (None, _USER, None, None))
_GIVEN = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}

_DELETE, _INSERT, _RENAME = 3, 2, 2


def _with_inserts(costs: Sequence[float]) -> Vector:
    """The costs where rows may be inserted first; two in a row can be of use, three never."""
    nothing, system, user, assistant = costs
    user, assistant = min(user, _INSERT + assistant), min(assistant, _INSERT + user)
    return min(nothing, _INSERT + user), min(system, _INSERT + user), user, assistant


#: After the last row, with nothing or an assistant's row as the end.
AT_END: Vector = _with_inserts((0, _NEVER, _NEVER, 0))


def _before(letter: str, after: Vector) -> Vector:
    """The costs before a row, from those after it."""
    role, fault = divmod(ord(letter) - 65, 4)
    costs = []
    for state in range(4):
        cost = _DELETE + after[state]
        if fault in (_WHOLE, _CUT):
            stays = int(fault == _CUT)
            cost = min(cost, stays + _RENAME + after[_GIVEN[state]])
            kept = _KEPT[state][role]
            if kept is not None:
                cost = min(cost, stays + after[kept])
        costs.append(cost)
    return _with_inserts(costs)


def _matrix(letters: str) -> list[list[float]]:
    """Least costs from each state before the letters to each state after them."""
    ends = []
    for end in range(4):
        costs: Vector = tuple(0 if state == end else _NEVER for state in range(4))
        for letter in reversed(letters):
            costs = _before(letter, costs)
        ends.append(costs)
    return [[ends[end][state] for end in range(4)] for state in range(4)]


_short_matrix = lru_cache(maxsize=1 << 16)(_matrix)


def walk(letters: str, after: Vector, state: int, last: bool) -> tuple[list[str], int]:
    """The edits of a block, one string for each row with the inserts before it, and the state after them.

    The last block of a conversation has one string more: what is inserted at the end.
    """
    costs = [after]
    for letter in reversed(letters):
        costs.append(_before(letter, costs[-1]))
    costs.reverse()
    edits, inserted = [], ""
    for i, letter in enumerate(letters):
        role, fault = divmod(ord(letter) - 65, 4)
        stays = int(fault == _CUT)
        while True:
            here, below = costs[i][state], costs[i + 1]
            if _DELETE + below[state] == here:
                edit = "D"
            elif _INSERT + costs[i][_GIVEN[state]] == here:
                inserted, state = inserted + "I", _GIVEN[state]
                continue
            elif fault in (_WHOLE, _CUT) and _KEPT[state][role] is not None and stays + below[_KEPT[state][role]] == here:
                edit, state = "K", _KEPT[state][role]
            else:
                edit, state = "R", _GIVEN[state]
            break
        edits.append(inserted + edit)
        inserted = ""
    if last:
        while state in (_SYSTEM, _USER):
            inserted, state = inserted + "I", _GIVEN[state]
        edits.append(inserted)
    return edits, state


_short_walk = lru_cache(maxsize=1 << 16)(walk)
_SHORT = 16


def _walk(letters: str, after: Vector, state: int, last: bool) -> tuple[list[str], int]:
    return (_short_walk if len(letters) <= _SHORT else walk)(letters, after, state, last)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length and, by their strings, of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= limit or weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_COSTS = pa.list_(pa.float64())
_SUMMED = pa.schema([("conv_id", pa.int64()), ("head", pa.int64()), ("letters", pa.string()), ("matrix", _COSTS), ("blank", pa.int64()),
                     ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.int32()), ("final", pa.int32())])
_SUMMED_SQL = ("conv_id long, head long, letters string, matrix array<double>, blank long, duplicate long, truncated long, illegal long, "
               "first int, final int")


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for row in _rows(batches):
            letters = row["letters"]
            matrix = (_short_matrix if len(letters) <= _SHORT else _matrix)(letters)
            roles, faults = zip(*(divmod(ord(letter) - 65, 4) for letter in letters))
            illegal = sum(pair not in _LEGAL for pair in zip(roles, roles[1:]))
            yield (row["conv_id"], row["head"], letters, [c for line in matrix for c in line], faults.count(_BLANK),
                   faults.count(_REPEAT), faults.count(_CUT), illegal, roles[0], roles[-1])
    return _batches(rows(), _SUMMED)


_CHECKED = pa.schema([("conv_id", pa.int64()), ("head", pa.int64()), ("after", _COSTS), ("last", pa.bool_()), ("parts", pa.int64()),
                      ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())])
_CHECKED_SQL = ("conv_id long, head long, after array<double>, last boolean, parts long, blank long, duplicate long, truncated long, illegal long, "
                "cost long")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checkpoint of every block, and on a conversation's last block its sums; blocks come in order."""
    def rows() -> Iterator[tuple]:
        for conv_id, blocks in groupby(_rows(batches), key=lambda row: row["conv_id"]):
            blocks, after, ends = list(blocks), AT_END, []
            for block in reversed(blocks):
                ends.append(after)
                matrix = block["matrix"]
                after = tuple(min(matrix[4 * state + end] + after[end] for end in range(4)) for state in range(4))
            sums = [sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")]
            sums[3] += sum((a["final"], b["first"]) not in _LEGAL for a, b in zip(blocks, blocks[1:]))
            for block, end in zip(blocks, reversed(ends)):
                last = block is blocks[-1]
                yield (conv_id, block["head"], list(end), last, len(blocks), *((*sums, int(after[_NOTHING])) if last else (None,) * 5))
    return _batches(rows(), _CHECKED)


_PASSED = pa.schema([("conv_id", pa.int64()), ("head", pa.int64()), ("states", pa.list_(pa.int32()))])


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each block for every state before it."""
    return _batches(((row["conv_id"], row["head"], [_walk(row["letters"], tuple(row["after"]), state, row["last"])[1] for state in range(4)])
                     for row in _rows(batches)), _PASSED)


_ENTERED = pa.schema([("head", pa.int64()), ("state", pa.int32())])


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block of a conversation, from its first block on."""
    def rows() -> Iterator[tuple]:
        for _, blocks in groupby(_rows(batches), key=lambda row: row["conv_id"]):
            state = _NOTHING
            for block in blocks:
                yield block["head"], state
                state = block["states"][state]
    return _batches(rows(), _ENTERED)


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("head", pa.int64()), ("parts", pa.int64()), ("place", pa.int64()), ("edit", pa.string()),
                       ("role", pa.string()), ("text", pa.string())])
_REPAIRED_SQL = "conv_id long, head long, parts long, place long, edit string, role string, text string"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows, of a block's edits followed by its rows; ``place`` counts them within the block."""
    def rows() -> Iterator[tuple]:
        edits, state, place, base = [], _NOTHING, 0, ()
        for row in _rows(batches):
            if row["letters"] is not None:
                state, place, base = row["state"], 0, (row["conv_id"], row["id"], row["parts"])
                edits = list(reversed(_walk(row["letters"], tuple(row["after"]), state, row["last"])[0]))
                left, last = len(row["letters"]), row["last"]
                continue
            left -= 1
            for edit in edits.pop() + (edits.pop() if last and not left else ""):
                role, text = None, None
                if edit == "K":
                    role, text = row["role"], row["text"]
                    state = _KEPT[state]["sua".find(role[:1])]
                elif edit != "D":
                    state = _GIVEN[state]
                    role, text = _ROLES[state], row["text"] if edit == "R" else ""
                yield (*base, place, edit, role, text)
                place += 1
    return _batches(rows(), _REPAIRED)


_PIECES = pa.schema([("conv_id", pa.int64()), ("head", pa.int64()), ("audit", pa.string()), ("sha256", pa.string()), ("piece", pa.string())])
_PIECES_SQL = "conv_id long, head long, audit string, sha256 string, piece string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each block, or its text where the conversation has others."""
    def rows() -> Iterator[tuple]:
        for (conv_id, head, parts), block in groupby(_rows(batches), key=lambda row: (row["conv_id"], row["head"], row["parts"])):
            audit, lines = [], []
            for row in block:
                audit.append(row["edit"])
                if row["role"] is not None:
                    lines.append(f"{row['role']}:{row['text']}")
            piece = "\n".join(lines)
            whole = parts == 1
            yield (conv_id, head, "".join(audit), _sha256(piece) if whole else None, None if whole else piece)
    return _batches(rows(), _PIECES)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_JOINED = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("sha256", pa.string())])
_JOINED_SQL = "conv_id long, audit string, sha256 string"


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of conversations of several blocks, whose pieces come in order and are not held."""
    def rows() -> Iterator[tuple]:
        for conv_id, pieces in groupby(_rows(batches), key=lambda row: row["conv_id"]):
            audit, digest, begun = [], hashlib.sha256(), False
            for row in pieces:
                audit.append(row["audit"])
                if row["piece"]:
                    digest.update((("\n" if begun else "") + row["piece"]).encode())
                    begun = True
            yield conv_id, "".join(audit), digest.hexdigest()
    return _batches(rows(), _JOINED)


class Repair(NamedTuple):
    """``rows``: the repaired rows with their edits, ``place`` within the block that begins with row ``head``, of ``parts``
    blocks of the conversation; deleted ones have neither role nor text. ``sums``: per conversation blank, duplicate,
    truncated, illegal and cost."""

    rows: DataFrame
    sums: DataFrame


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the CRC-32 of ``conv_id:turn`` decides; nulls in role and text are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def _letter(repeat: Column) -> Column:
    """The letter of a row: its initial's code times four and its first fault's."""
    role = F.substring("role", 1, 1)
    code = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(_OTHER)
    fault = F.when(F.col("end") == "", _BLANK).when(repeat, _REPEAT).when(~F.col("end").isin(*STOPS), _CUT).otherwise(_WHOLE)
    return F.char(65 + 4 * code + fault)


def numbered(rows: DataFrame) -> DataFrame:
    """The rows in their order, written with numbers: ``id`` ascends through a conversation, ``end`` is the last sign."""
    prefix = F.substring("text", 1, 32).alias("prefix")
    keys = ["conv_id", "turn", "role"]
    ordered = rows.select("*", prefix).repartitionByRange(*keys, "prefix").sortWithinPartitions(*keys, "text")
    return written(ordered.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("id"),
        F.unhex(F.sha2("text", 256)).alias("hash"), F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).alias("end")))


def repair(rows: DataFrame, min_block: int = MIN_BLOCK) -> Repair:
    """Repairs the conversations of ``numbered`` rows."""
    python_ready(rows)
    bits = max(min_block, isqrt(rows.count())).bit_length()
    chunk = F.shiftright("id", bits)
    firsts = rows.where("end <> ''").groupBy("conv_id", "role", "hash").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    letters = rows.select("conv_id", "id", "role", "end").join(firsts, "id", "left").select(
        "conv_id", "id", _letter(F.col("first").isNull()).alias("letter"))
    # A block has at most 2**bits rows, so its list is bounded.
    blocks = letters.groupBy("conv_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("id", "letter"))).alias("rows")).select(
        "conv_id", F.col("rows")[0]["id"].alias("head"), F.concat_ws("", "rows.letter").alias("letters"))
    blocks = written(blocks.mapInArrow(tidy(_sum_up), _SUMMED_SQL))
    narrow = blocks.drop("letters").repartition("conv_id").sortWithinPartitions("conv_id", "head")
    checked = written(narrow.mapInArrow(tidy(_check), _CHECKED_SQL))
    edits = blocks.select("head", "letters").join(checked.select("conv_id", "head", "after", "last", "parts"), "head")
    passed = edits.where("parts > 1").mapInArrow(tidy(_pass), "conv_id long, head long, states array<int>")
    entered = passed.repartition("conv_id").sortWithinPartitions("conv_id", "head").mapInArrow(tidy(_enter), "head long, state int")
    edits = edits.join(entered, "head", "left").select(
        F.col("head").alias("id"), "conv_id", "letters", "after", "last", "parts", F.coalesce("state", F.lit(_NOTHING)).alias("state"))
    texts = rows.select("id", "role", "text")
    both = edits.unionByName(texts, allowMissingColumns=True).withColumn("chunk", chunk)
    # The edits of a block have the number of its first row and come before it.
    both = both.repartition("chunk").sortWithinPartitions("chunk", "id", F.col("letters").isNull())
    sums = checked.where("last").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")
    return Repair(both.mapInArrow(tidy(_repair), _REPAIRED_SQL), sums)


def repair_conversations(conversations: DataFrame, min_block: int = MIN_BLOCK) -> DataFrame:
    """Per ``conv_id`` of the table: the faults of its rows after the damage, the cheapest edits and the repaired text's hash."""
    rows = numbered(damaged(conversations))
    repaired = repair(rows, min_block)
    pieces = written(repaired.rows.mapInArrow(tidy(_digest), _PIECES_SQL))
    whole = pieces.where("piece IS NULL").select("conv_id", "audit", "sha256")
    several = pieces.where("piece IS NOT NULL").select("conv_id", "head", "audit", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "head")
    digests = whole.unionByName(several.mapInArrow(tidy(_join_pieces), _JOINED_SQL))
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    names = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = names.unionByName(gaps, True).unionByName(repaired.sums, True).unionByName(digests, True)
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.lit(_sha256(""))).alias("repaired_sha256"))
