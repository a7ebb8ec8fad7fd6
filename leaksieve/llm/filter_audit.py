"""How five quality filters act on each other, whatever the order they are applied in.

The filters judge whole texts; words are ``[^\\x20\\x09-\\x0D]+``. A text fails

* ``A`` with fewer than 200 words,
* ``B`` when less than half of its words are distinct,
* ``C`` when more than 2 % of its code points are ``A`` to ``Z``,
* ``D`` when it holds any of ``#$%&*|``,
* ``E`` when a row with a smaller ``doc_id`` has the same text, removed or not.

Duplicates are found with radix tries that hold whole texts and the least id at their ends:

1. Every task of the input puts its texts into a trie, a bounded share at a time (``SHARE_BYTES`` of
   distinct bytes or ``SHARE_ROWS`` rows), judges each distinct text once, and writes one narrow row per
   document with the number of its text in that share. A text itself is written once per share: a group of copies
   that holds a third of the table shrinks to a few rows a task before anything is shuffled.
2. The texts are range-partitioned by prefixes that adapt to them: eight bytes, and four times as many as
   long as the texts behind a prefix weigh more than ``PREFIX_BYTES`` (and a 2**18th of all, so that the list of heavy
   prefixes is bounded). Equal texts have equal prefixes. Each prefix gets a trie of its own; when it is full of
   the prefix's texts, its ends hold the least id of each text in the table.
3. The least ids go back to the narrow rows by the numbers, which no group of copies makes frequent, and a row fails
   ``E`` if its id is larger.

Failures are five bits of a mask. Masks are counted per part, and the counts give all orders: what is kept after some filters
is what fails none of them, so 32 sums per part answer the steps of 120 orders. A text that fails k filters is
removed by each of them in 120 / k of the orders, which gives the Shapley sums.

Defined results: a null text is empty; an empty one has no words (fails ``A``). A row without id fails no ``E`` and makes no
other row fail; rows that repeat an id and its text do not fail each other. A document is good (toxic) if any row of the labels
says so; ids without labels are neither. A null source is the empty part. An empty table has no parts and gives
no rows. Only ``doc_id``, ``text`` and ``source`` of the documents and ``doc_id``, ``quality`` and ``toxic`` of the labels are read, so
further columns may have any names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from leaksieve.llm.shared import python_ready, tidy, written
from leaksieve.llm.tries import Trie

FILTERS = "ABCDE"
SHARE_BYTES = 16 << 20
SHARE_ROWS = 1 << 16
TARGET_BYTES = 8 << 20
#: Bytes of texts behind one prefix; the prefixes of a task are dealt by ranges.
PREFIX_BYTES = 1 << 18

_MASKS = range(1 << len(FILTERS))
_BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
_FIRST_PREFIX = 8
_LONGER = 4
# Rows of one batch handed back to Spark.
_OUT_ROWS = 4096

_NOTED = "node long, doc_id long, part string, mask int, text binary, least long"
_ENDS = "node long, least long"


def failures(text: bytes) -> int:
    """The bits of the filters ``A`` to ``D`` that a text fails."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (_BIT["A"] * (len(words) < 200) | _BIT["B"] * (100 * len(set(words)) < 50 * len(words))
            | _BIT["C"] * (100 * capitals > 2 * points) | _BIT["D"] * signs)


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = b"#$%&*|"
# Bytes that continue a code point.
_CONTINUED = bytes(range(0x80, 0xC0))


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The narrow rows of a task's documents, with a text and its least id on the first row of each text of a share."""
    base, done = TaskContext.get().partitionId() << 40, 0
    trie, rows, masks = Trie(), [], []
    for batch in batches:
        for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
            number = trie.put(text, doc_id)
            new = number == len(masks)
            if new:
                masks.append(failures(text))
            rows.append((number, doc_id, part, text if new else None))
            if trie.size >= SHARE_BYTES or len(rows) >= SHARE_ROWS:
                yield from _noted(base + done, trie, rows, masks)
                done += len(masks)
                trie, rows, masks = Trie(), [], []
    yield from _noted(base + done, trie, rows, masks)


def _noted(base: int, trie: Trie, rows: list[tuple], masks: list[int]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), _OUT_ROWS):
        numbers, ids, parts, texts = zip(*rows[i:i + _OUT_ROWS])
        yield pa.RecordBatch.from_arrays([
            pa.array([base + n for n in numbers], pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.string()),
            pa.array([masks[n] for n in numbers], pa.int32()), pa.array(texts, pa.binary()),
            pa.array([None if t is None else trie.least[n] for n, t in zip(numbers, texts)], pa.int64()),
        ], names=["node", "doc_id", "part", "mask", "text", "least"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least id of every node's text, from one trie for each prefix; rows come in the order of prefixes."""
    trie, nodes, prefix = Trie(), [], None
    for batch in batches:
        for node, key, text, least in zip(*(batch.column(c).to_pylist() for c in ("node", "prefix", "text", "least"))):
            if key != prefix:
                yield from _ended(trie, nodes)
                trie, nodes, prefix = Trie(), [], key
            nodes.append((node, trie.put(text, least)))
    yield from _ended(trie, nodes)


def _ended(trie: Trie, nodes: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if nodes:
        yield pa.RecordBatch.from_arrays([
            pa.array([node for node, _ in nodes], pa.int64()), pa.array([trie.least[n] for _, n in nodes], pa.int64())],
            names=["node", "least"])


def with_adaptive_prefix(texts: DataFrame, target: int = PREFIX_BYTES) -> tuple[DataFrame, int]:
    """The rows with a ``prefix`` of their binary ``text``, and the bytes of all texts.

    Prefixes behind which more than ``target`` bytes lie are made longer, until there are none but
    those that are whole texts.
    """
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    target = max(target, total >> 18)
    length = _FIRST_PREFIX
    texts = texts.withColumn("prefix", F.substring("text", 1, length))
    while True:
        # Only prefixes of the present length can be heavy still; fewer than total / target are.
        heavy = (texts.where(F.octet_length("prefix") == length).groupBy("prefix")
                 .agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("longest"))
                 .where((F.col("n") > target) & (F.col("longest") > length)).select("prefix").collect())
        if not heavy:
            return texts, total
        length *= _LONGER
        found = F.broadcast(spark.createDataFrame([(bytes(r.prefix), True) for r in heavy], "prefix binary, heavy boolean"))
        texts = texts.join(found, "prefix", "left").withColumn(
            "prefix", F.when(F.col("heavy"), F.substring("text", 1, length)).otherwise(F.col("prefix"))).drop("heavy")


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: bit 0 for filter ``A`` to bit 4 for filter ``E``."""
    spark = docs.sparkSession
    rows = python_ready(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    noted = written(rows.mapInArrow(tidy(_note), _NOTED))
    texts, total = with_adaptive_prefix(noted.where("text IS NOT NULL").select("node", "text", "least"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TARGET_BYTES)
    ordered = texts.repartitionByRange(tasks, "prefix").sortWithinPartitions("prefix").select("node", "prefix", "text", "least")
    least = written(ordered.mapInArrow(tidy(_ends), _ENDS))
    repeated = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return noted.select("node", "doc_id", "part", "mask").join(least, "node").select(
        "doc_id", "part", F.when(repeated, F.col("mask").bitwiseOR(_BIT["E"])).otherwise(F.col("mask")).alias("mask"))


def _steps() -> str:
    """All orders and their steps: the filters applied before the step and after it, as masks, and the step's own."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            after = before | _BIT[letter]
            rows.append({"filter_order": "".join(order), "step": step, "before": before, "after": after, "bit": _BIT[letter]})
            before = after
    return json.dumps(rows)


def _passing(weight: str) -> Column:
    """For each set of filters, the sum over the documents that fail none of them."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(applied) == 0, F.col(weight))), F.lit(0)) for applied in _MASKS])


def _failing(weight: Column, alone: bool) -> Column:
    """For each filter, by its bit, the sum over the documents that fail it, or it alone."""
    by_bit = {}
    for bit in _BIT.values():
        fails = F.col("mask") == bit if alone else F.col("mask").bitwiseAND(bit) != 0
        by_bit[bit] = F.coalesce(F.sum(F.when(fails, weight)), F.lit(0))
    return F.array(*[by_bit.get(mask, F.lit(0).cast("long")) for mask in _MASKS])


def interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step what the step keeps and removes, from (doc_id, part, mask)."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Counted before the join, so that no id, nor its absence, brings many rows into one task.
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # A text that fails k filters is removed by each in 120 / k orders.
    share = (F.lit(120) / F.nullif(F.bit_count("mask"), F.lit(0))).cast("long")
    sums = counts.groupBy("part").agg(
        *[_passing(c).alias(c) for c in ("n", "good", "toxic")],
        _failing(F.col("n"), alone=True).alias("alone"), _failing(F.col("n") * share, alone=False).alias("shapley"))
    schema = "array<struct<filter_order:string,step:int,before:int,after:int,bit:int>>"
    steps = sums.select("*", F.explode(F.from_json(F.lit(_steps()), schema)).alias("s"))

    def removed(sums: str) -> Column:
        return F.col(sums)[F.col("s.before")] - F.col(sums)[F.col("s.after")]

    return steps.select(
        "part", "s.filter_order", "s.step", F.col("n")[F.col("s.after")].alias("kept"), removed("n").alias("removed"),
        (F.col("n")[0] - F.col("n")[F.col("s.bit")] - removed("n")).alias("redundant"),
        F.col("alone")[F.col("s.bit")].alias("unique_fails"), removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"), F.col("shapley")[F.col("s.bit")].alias("shapley"))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    return interactions(failure_masks(docs), labels)
