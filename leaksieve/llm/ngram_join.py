"""N-gram Jaccard join by T-occurrence search, with the long inverted lists probed and not merged.

A document is the set of its distinct word n-grams. Two documents link when
``100 * |A and B| >= percent * |A or B|``. A document with n grams needs
``T = ceil(percent * n / 100)`` of its n inverted lists to hold a partner. With its ``T - OFTEN``
longest lists set aside, a partner must occur in at least ``OFTEN`` of the remaining short lists. So only
the short lists are merged and occurrences counted (DivideSkip); what a candidate holds of the long
lists is then found by binary search in its own sorted set of grams. A pair of sizes m and n needs
``ceil(percent * (m + n) / (100 + percent))`` common grams, mostly more than T; the lists that are short for
that number alone are counted for it, so documents that share a frequent passage and no more are not paired.

How it runs:

1. One pass over the texts turns each into ``(node, n_shingles)``; the node is a hash of the whole
   set, so copies are one node from then on. The same pass counts grams; the ``HEAVY`` most
   frequent ones become everybody's last (longest) lists. Any order of the lists that all documents
   share gives the same links, so the counts need not be exact.
2. A second pass emits the short lists' postings. They are dealt out by gram. Lists of heavy grams
   are dealt out in blocks, so that a gram that a third of all documents hold is no single task.
3. Round one proposes for each member of a list its neighbours in order of size, in a long list also
   in two random orders: pairs in proportion to the postings. Those that share ``OFTEN`` lists, or a long
   one, are probed; the ones that reach T become links, and the links components. Before a pair is probed, parities of both
   sets, a thirtieth of their size, are compared: where more of them differ than grams of a linked pair can, no set is moved.
   Twice more, members of a long list outside its largest component are proposed to a few members of that.
   Lists with the same first member go to one task, so that lists of one group propose a pair once; where these have
   very many members, to several.
4. Round two is exact: members of a list that are in different components and of fitting size are
   all counted, those with enough common lists probed. A large group of near copies is one component by then and proposes nothing.

Grams and nodes are 64-bit hashes; grams of different words are equal with a chance of 2**-64 a pair.

Defined results: a null, empty or blank text has no grams and links with nothing; a text of fewer words
than n is one gram of all its words; repeated rows and copies share a component; rows with a null
id belong to the components they link with, but a component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leaksieve.llm.arrays import blocks, buffers, mix, signed, words
from leaksieve.llm.components import components
from leaksieve.llm.shared import bucketed, discard, free_name, python_ready, tidy, written

#: Grams whose lists count as long for everybody: two numbers each, 4 MB on the driver and in each task.
HEAVY = 1 << 18
#: Most frequent grams that one task of the first pass reports.
HEAVY_PER_TASK = 1 << 14
#: Postings of a heavy gram in one block, about.
LIST_BLOCK = 1 << 14
#: Short lists that two linked documents share at least, or fewer where ``enough`` says that the smallest that can link have fewer.
OFTEN = 4
#: Members from which a list is long enough for a proposal of round one to need no second list.
LONG_LIST = 16
#: Neighbours in an order that round one proposes for a member of a list.
NEIGHBOURS = 2

#: Members of lists with one first member that go to one task, at least, and members of all lists that do, about.
HEAD_ROWS, TASK_ROWS = 1 << 11, 1 << 16
#: Bytes of sets in one bucket, about.
BUCKET_BYTES = 128 << 20
#: Bits of the filter by which the texts whose sets are needed are found: 16 for each, and at most so many.
FILTER_BITS = 1 << 27

_PASS_ONE = "kind int, doc_id long, tkey long, node long, n_shingles long, gram long, cnt long"
#: Members of a list's largest component that a member outside it is proposed to, and how often that is done.
ATTACHED, ATTACH_ROUNDS = 8, 2
_PAIRS = "a long, b long, met long"
_POSTINGS = "gram long, parts int, block int, node long, n int, pos int"
_LISTS = f"{_POSTINGS}, head long, is_long int"


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of each text, words lower-cased from A-Z."""
    for first, last in blocks(offsets):
        hashes, _, begin = words(data, offsets[first:last + 1], lower=True)
        grams = hashes.copy()
        for k in range(1, size):
            grams[:-k or None] = mix(grams[:-k or None] + np.uint64(k)) + hashes[k:] if len(hashes) > k else grams[:0]
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= size:
                yield np.unique(grams[a:b - size + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = mix(np.array([whole], np.uint64))[0] ^ h
                yield mix(np.array([whole], np.uint64))
            else:
                yield grams[:0]


def node_of(grams: np.ndarray) -> int:
    """One hash for a whole set."""
    total = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(signed(mix(np.array([total], np.uint64)))[0])


def needed(n, percent: int):
    """T: how many of a document's n lists must hold a partner."""
    return -(-n * percent // 100)


def _counts(m, n, pos_m, pos_n, percent: int, often: int):
    """Whether a list, at these places in the orders of two sets of sizes m and n, is among the short ones of the pair.

    With ``often`` 1: among those of which two linked sets share at least one.
    """
    common = needed_by(m, n, percent)
    return (pos_m < m - common + often) & (pos_n < n - common + often)


def needed_by(m, n, percent: int):
    """How many grams two linked sets of sizes m and n share at least."""
    return -(-(m + n) * percent // (100 + percent))


def enough(percent: int) -> int:
    """``OFTEN``, or the grams that the smallest different sets that can link have in common, if these are fewer."""
    least = max(1, -(-percent // (100 - percent))) if percent < 100 else OFTEN
    return min(OFTEN, max(1, needed_by(least, least, percent)))


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            nodes, sizes, gathered = [], [], []

            def count():
                nonlocal counted, totals
                if gathered:
                    grams, n = np.unique(np.concatenate(gathered), return_counts=True)
                    often = n > 1
                    merged = np.concatenate([counted, grams[often]])
                    counted, back = np.unique(merged, return_inverse=True)
                    totals = np.bincount(back, np.concatenate([totals, n[often]])).astype(np.int64)
                    if len(counted) > 8 * HEAVY_PER_TASK:
                        top = np.sort(np.argpartition(-totals, HEAVY_PER_TASK)[:4 * HEAVY_PER_TASK])
                        counted, totals = counted[top], totals[top]
                    gathered.clear()

            held = 0
            for grams in gram_sets(data, offsets, size):
                nodes.append(node_of(grams))
                sizes.append(len(grams))
                gathered.append(grams)
                held += len(grams)
                if held > 1 << 20:
                    count()
                    held = 0
            count()
            rows = batch.num_rows
            yield pa.record_batch({
                "kind": pa.array(np.zeros(rows, np.int32)), "doc_id": batch.column("doc_id"), "tkey": batch.column("tkey"),
                "node": pa.array(nodes, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()),
                "gram": pa.nulls(rows, pa.int64()), "cnt": pa.nulls(rows, pa.int64())})
        top = np.argsort(-totals, kind="stable")[:HEAVY_PER_TASK]
        rows = len(top)
        none = pa.nulls(rows, pa.int64())
        yield pa.record_batch({
            "kind": pa.array(np.ones(rows, np.int32)), "doc_id": none, "tkey": none, "node": none, "n_shingles": none,
            "gram": pa.array(signed(counted[top])), "cnt": pa.array(totals[top])})
    return run


def _postings(size: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = heavy.value
        seen: set[int] = set()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            parts, held = [], 0
            for grams in gram_sets(data, offsets, size):
                n = len(grams)
                if 100 * n < percent * (n + 1):
                    continue  # only equal sets can link, and those are one node
                node = node_of(grams)
                if node in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(node)
                parts.append(_short_lists(grams, node, n - needed(n, percent) + enough(percent), known, weight))
                held += len(parts[-1][0])
                if held > 1 << 18:
                    yield _posting_batch(parts)
                    parts, held = [], 0
            if parts:
                yield _posting_batch(parts)
    return run


def _short_lists(grams, node, short, known, weight):
    """The shortest lists of a set: grams that are not heavy, in order of hash, then heavy ones, the rarest first."""
    at = np.searchsorted(known, grams)
    at[at == len(known)] = 0
    is_heavy = known[at] == grams if len(known) else np.zeros(len(grams), bool)
    chosen = grams[~is_heavy][:short]
    parts = np.ones(len(chosen), np.int32)
    if len(chosen) < short:
        held = at[is_heavy]
        held = held[np.lexsort((held, weight[held]))][:short - len(chosen)]
        chosen = np.concatenate([chosen, known[held]])
        parts = np.concatenate([parts, (1 + weight[held] // LIST_BLOCK).astype(np.int32)])
    return chosen, parts, node, len(grams)


def _posting_batch(found):
    sizes = [len(p[0]) for p in found]
    parts = np.concatenate([p[1] for p in found])
    nodes = np.repeat(np.array([p[2] for p in found], np.int64), sizes)
    first = np.cumsum([0, *sizes[:-1]])
    return pa.record_batch({
        "gram": pa.array(signed(np.concatenate([p[0] for p in found]))), "parts": pa.array(parts),
        "block": pa.array(((nodes & 0x7FFFFFFF) % parts).astype(np.int32)), "node": pa.array(nodes),
        "n": pa.array(np.repeat(np.array([p[3] for p in found], np.int32), sizes)),
        "pos": pa.array((np.arange(len(parts)) - np.repeat(first, sizes)).astype(np.int32))})


def _lists(batches: Iterator[pa.RecordBatch], *more: str):
    """All rows of a task in order of list and size, repeated postings once; and where each list begins."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    rows = {c: table.column(c).to_numpy() for c in ("gram", "block", "n", "node", "parts", "pos", *more)}
    order = np.lexsort((rows["node"], rows["n"], rows["block"], rows["gram"]))
    rows = {c: v[order] for c, v in rows.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("gram", "block", "node")], axis=0)
    rows = {c: v[fresh] for c, v in rows.items()}
    gram, block = rows["gram"], rows["block"]
    return rows, np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of lists that more than one node shares, or that have other blocks."""
    if found := _lists(batches):
        rows, starts = found
        sizes = np.diff(np.append(starts, len(rows["gram"])))
        keep = np.repeat(sizes > 1, sizes) | (rows["parts"] > 1)
        rows["head"] = np.repeat(rows["node"][starts], sizes)
        rows["is_long"] = (np.repeat(sizes >= LONG_LIST, sizes) | (rows["parts"] > 1)).astype(np.int32)
        yield pa.record_batch({c: pa.array(rows[c][keep]) for c in ("gram", "parts", "block", "node", "n", "pos", "head", "is_long")})


def _pair_batch(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct pairs, the smaller node first, and in how many lists each was met."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    weight = np.ones(len(a), np.int64) if weight is None else weight[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    met = np.add.reduceat(weight, first) if len(a) else weight
    return pa.record_batch({"a": pa.array(a[first]), "b": pa.array(b[first]), "met": pa.array(met)})


def _neighbours(percent: int):
    """Proposals of round one: neighbours by size; in long lists also by two orders of hashes, the same in all lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _lists(batches)
        if not found:
            return
        rows, starts = found
        sizes = np.diff(np.append(starts, len(rows["gram"])))
        long = np.repeat(sizes >= LONG_LIST, sizes)
        left, right, weight = [], [], []

        def propose(rows: dict[str, np.ndarray], in_long: bool) -> None:
            gram, block, node, n, pos = (rows[c] for c in ("gram", "block", "node", "n", "pos"))
            n = n.astype(np.int64)
            for k in range(1, NEIGHBOURS + 1):
                near = (gram[k:] == gram[:-k]) & (block[k:] == block[:-k])
                near &= (n[:-k] * 100 >= n[k:] * percent) & (n[k:] * 100 >= n[:-k] * percent)
                if not in_long:
                    near &= _counts(n[:-k], n[k:], pos[:-k], pos[k:], percent, enough(percent))
                left.append(node[:-k][near])
                right.append(node[k:][near])
                weight.append(np.full(len(left[-1]), enough(percent) if in_long else 1))

        propose({c: v[~long] for c, v in rows.items()}, False)
        rows = {c: v[long] for c, v in rows.items()}
        propose(rows, True)
        for seed in (1, 2):
            scattered = mix(rows["node"].view(np.uint64) ^ np.uint64(seed))
            order = np.lexsort((scattered, rows["block"], rows["gram"]))
            propose({c: v[order] for c, v in rows.items()}, True)
        yield _pair_batch(np.concatenate(left), np.concatenate(right), np.concatenate(weight))
    return run


def _attach(percent: int, seed: int):
    """In long lists: pairs of a member outside the largest component and some members of that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _lists(batches, "component")
        if not found:
            return
        rows, starts = found
        left, right = [], []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(rows["gram"])).tolist()):
            if b - a < LONG_LIST:
                continue
            node, n = rows["node"][a:b], rows["n"][a:b].astype(np.int64)
            _, owner, counts = np.unique(rows["component"][a:b], return_inverse=True, return_counts=True)
            inside = owner == counts.argmax()
            core, outer = np.flatnonzero(inside), np.flatnonzero(~inside)
            for k in range(ATTACHED):
                # The draw depends on the node alone, so that lists of one group draw alike.
                drawn = core[(mix(node[outer].view(np.uint64) ^ np.uint64(seed << 8 | k)) % np.uint64(len(core))).astype(np.int64)]
                fits = (n[outer] * 100 >= n[drawn] * percent) & (n[drawn] * 100 >= n[outer] * percent)
                left.append(node[outer[fits]])
                right.append(node[drawn[fits]])
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            yield _pair_batch(left, right, np.full(len(left), enough(percent)))
    return run


def _across(percent: int):
    """Pairs of a list's members that are in different components and of fitting size, and what the list counts for.

    A long list is worth ``enough`` to pairs that need it among their first lists, and nothing to
    others. In a short list a pair is worth one, and one for each long list that both may share.
    The lists of linked sets add up to ``enough``: either their first common list is long, or a
    short one makes up for the long ones.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _lists(batches, "component", "copied", "is_long", "longs")
        if not found:
            return
        rows, starts = found
        left, right, weight, held = [], [], [], 0
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(rows["gram"])).tolist()):
            component, copied, node, longs, pos = (rows[c][a:b] for c in ("component", "copied", "node", "longs", "pos"))
            if (component == component[0]).all():
                continue
            n, is_long = rows["n"][a:b].astype(np.int64), rows["is_long"][a]
            # Sizes ascend, so the fitting partners of a member are one range behind it.
            stop = np.searchsorted(n, n * 100 // percent, side="right")
            for i in range(b - a - 1):
                later = slice(i + 1, stop[i])
                fits = (component[later] != component[i]) & _counts(n[i], n[later], pos[i], pos[later], percent, 1 if is_long else enough(percent))
                fits &= ~(copied[later] & copied[i])
                partners = node[later][fits]
                if len(partners):
                    left.append(np.full(len(partners), node[i]))
                    right.append(partners)
                    weight.append(np.full(len(partners), enough(percent)) if is_long else 1 + np.minimum(longs[i], longs[later][fits]))
                    held += len(partners)
            if held > 1 << 20:
                yield _pair_batch(*map(np.concatenate, (left, right, weight)))
                left, right, weight, held = [], [], [], 0
        if left:
            yield _pair_batch(*map(np.concatenate, (left, right, weight)))
    return run


def _bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The bits that a task's keys set in a filter of ``size`` bits, as pieces of 64 KiB."""
    bits = np.zeros(size, bool)
    for batch in batches:
        for places in _places(batch.column("id").to_numpy(), size):
            bits[places] = True
    packed, piece = np.packbits(bits), 1 << 16
    used = [i for i in range(0, len(packed), piece) if packed[i:i + piece].any()]
    yield pa.record_batch({"at": pa.array(used, pa.int64()), "bits": pa.array([packed[i:i + piece].tobytes() for i in used], pa.binary())})


def _places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    ids = ids.astype(np.int64).view(np.uint64)
    return [(mix(ids ^ np.uint64(seed)) % np.uint64(size)).astype(np.int64) for seed in (11, 12, 13, 14)]


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one place, put together."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, bits in zip(batch.column("at").to_pylist(), batch.column("bits").to_pylist()):
            bits = np.frombuffer(bits, np.uint8)
            found[at] = found[at] | bits if at in found else bits
    yield pa.record_batch({"at": pa.array(list(found), pa.int64()), "bits": pa.array([b.tobytes() for b in found.values()], pa.binary())})


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A filter that lets the ``id`` of all rows pass, and few others while there are not very many: at most ``FILTER_BITS``."""
    size = 1 << 16
    while size < min(FILTER_BITS, 16 * ids.count()):
        size *= 2
    pieces = ids.mapInArrow(partial(_bits, size=size), "at long, bits binary").repartition("at").mapInArrow(_either, "at long, bits binary").collect()
    packed = np.zeros(size // 8, np.uint8)
    for r in pieces:
        packed[r.at:r.at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return packed


def sketch(grams: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of a set's grams falls on each of some places, two for each gram or more, as packed bits.

    Each gram that only one of two sets holds changes one place: places at which two sketches differ are at most such grams.
    """
    size = 1 << max(6, (2 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 == 1)


def may_link(x: np.ndarray, y: np.ndarray, m: int, n: int, percent: int) -> bool:
    """Whether sets of sizes m and n with these sketches can link; true for all that do."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum()) <= m + n - 2 * needed_by(m, n, percent)


def _set_batch(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({
        "node": pa.array(nodes, pa.int64()), "n": pa.array(map(len, sets), pa.int32()),
        "sketch": pa.array([sketch(g).tobytes() for g in sets], pa.binary()), "grams": pa.array([g.tobytes() for g in sets], pa.binary())})


_SETS = "node long, n int, sketch binary, grams binary"


def _sets(size: int, wanted):
    """The sets of the texts that the filter lets pass, and their sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value).view(bool)
        for batch in batches:
            passes = np.logical_and.reduce([bits[p] for p in _places(batch.column("id").to_numpy(), len(bits))])
            data, offsets = buffers(batch.column("text").filter(pa.array(passes)))
            nodes, held, total = [], [], 0
            for grams in gram_sets(data, offsets, size):
                nodes.append(node_of(grams))
                held.append(grams)
                total += grams.nbytes
                if total > 1 << 23:
                    yield _set_batch(nodes, held)
                    nodes, held, total = [], [], 0
            if nodes:
                yield _set_batch(nodes, held)
    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a bucket once: repeated rows have one set."""
    seen: set[int] = set()
    for batch in batches:
        fresh = [node not in seen and not seen.add(node) for node in batch.column("node").to_pylist()]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _compare(percent: int):
    """Keeps pairs whose sketches let them link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("sa"), batch.column("sb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            kept = pa.array([may_link(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8), m, n, percent)
                             for x, y, m, n in sides], pa.bool_())
            yield pa.record_batch({"a": batch.column("a").filter(kept), "b": batch.column("b").filter(kept)})
    return run


def _probe(percent: int):
    """Keeps pairs that share enough grams: each gram of the smaller set is looked up in the larger by binary search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ga"), batch.column("gb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[i] = both * 100 >= percent * (len(x) + len(y) - both)
            kept = pa.array(keep)
            yield pa.record_batch({"a": batch.column("a").filter(kept), "b": batch.column("b").filter(kept)})
    return run


def ngram_groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text); see the module."""
    spark = python_ready(docs).sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text"))
    row_id = F.xxhash64("doc_id", "tkey").alias("id")
    scanned = written(texts.mapInArrow(tidy(_scan(size)), _PASS_ONE))
    rows = scanned.where("kind = 0").select("doc_id", "tkey", "node", "n_shingles")

    top = scanned.where("kind = 1").groupBy("gram").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "gram").limit(HEAVY).toArrow()
    grams = top.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    heavy = spark.sparkContext.broadcast((grams[order], top.column("cnt").to_numpy()[order].astype(np.int64)))

    postings = texts.select("text").mapInArrow(tidy(_postings(size, percent, heavy)), _POSTINGS)
    lists = written(postings.repartition("gram", "block").mapInArrow(tidy(_merge_lists), _LISTS))

    # One text of each node stands for it where its set is needed.
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tkey")).alias("r"))
    shared = lists.groupBy("node").agg(F.count("*").alias("c"), F.sum("is_long").alias("longs"))
    wanted = nodes.join(shared.where(F.col("c") >= enough(percent)), "node", "left_semi").select("r.doc_id", "r.tkey").select(row_id)
    # The texts are not moved to find them: a filter of bounded size lets them pass, and some more whose sets nobody asks for.
    passing = spark.sparkContext.broadcast(_filter_of(written(wanted)))
    # Bucketed by node: the joins below move pairs and never the table of sets.
    held = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * held // BUCKET_BYTES)
    sets = bucketed(texts.select(row_id, "text").mapInArrow(tidy(_sets(size, passing)), _SETS), "node", buckets, _once)

    # Lists of one first member go to one task, but for those of very many members: fewer than 1,024 have more than a 1,024th of all.
    total = lists.count()
    limit = max(HEAD_ROWS, total >> 10)
    many = lists.groupBy("head").count().where(F.col("count") > limit).select("head", F.ceil(F.col("count") / limit).cast("long").alias("shares")).collect()
    many = F.broadcast(spark.createDataFrame(many, "head long, shares long"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)

    def by_head(frame: DataFrame) -> DataFrame:
        shared_out = frame.join(many, "head", "left").withColumn("share", F.pmod(F.xxhash64("gram"), F.coalesce("shares", F.lit(1))))
        return shared_out.repartition(tasks, "head", "share").drop("share", "shares")

    def linked(pairs: DataFrame) -> DataFrame:
        often = pairs.groupBy("a", "b").agg(F.sum("met").alias("met")).where(F.col("met") >= enough(percent)).drop("met")
        # Most pairs do not link: what moves for these is a sketch of one of their sets.
        sides = often.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        sides = sides.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        near = written(sides.mapInArrow(tidy(_compare(percent)), "a long, b long"))
        sides = near.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
        sides = sides.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
        return written(sides.mapInArrow(tidy(_probe(percent)), "a long, b long"))

    near = _neighbours(percent)
    # Lists in blocks are dealt out a second time by another hash, which joins what the blocks keep apart.
    dealt_again = lists.where("parts > 1").withColumn("block", F.expr("cast(pmod(xxhash64(node), parts) AS int)"))
    links = linked(by_head(lists).mapInArrow(near, _PAIRS).unionByName(
        dealt_again.repartition("gram", "block").mapInArrow(near, _PAIRS)))

    def labelled() -> DataFrame:
        return lists.join(components(links, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    for seed in range(1, ATTACH_ROUNDS + 1):
        links = links.unionByName(linked(by_head(labelled().where("is_long = 1")).mapInArrow(_attach(percent, seed), _PAIRS)))

    members = written(labelled().join(shared.select("node", "longs"), "node"))
    whole = members.where("parts = 1").withColumn("copied", F.lit(False))
    in_blocks = members.where("parts > 1")
    # Of a list in blocks, all but its largest component go to every block, so that each pair meets once.
    largest = in_blocks.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(
        F.max_by("component", F.struct("c", "component")).alias("largest"))
    placed = in_blocks.join(largest, "gram").withColumn(
        "to", F.when(F.col("component") == F.col("largest"), F.array("block")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("to", F.explode("to")).withColumn("copied", (F.col("component") != F.col("largest")) & (F.col("to") > 0))
    placed = placed.drop("block", "largest").withColumnRenamed("to", "block")
    across = by_head(whole).mapInArrow(_across(percent), _PAIRS).unionByName(
        placed.repartition("gram", "block").mapInArrow(_across(percent), _PAIRS))
    links = links.unionByName(linked(across))

    found = components(links, "a", "b")
    # What follows reads the first pass and the components only.
    discard(lists, members, sets)
    firsts = nodes.select("node", F.col("r.doc_id").alias("least")).join(found, "node", "left")
    firsts = firsts.withColumn("component", F.coalesce("component", "node"))
    heads = firsts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = firsts.join(heads, "component").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first_of_group(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, but one of each group of linked texts: the smallest ``doc_id``, nulls last, of repeated rows one.

    Texts without a word are in no group and stay.
    """
    key = free_name(docs, "_key")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()))
    groups = ngram_groups(keyed.select(F.col(key).alias("doc_id"), "text"), size, percent).select(
        F.col("doc_id").alias(key), F.col("component_id").alias("_component"))
    named = keyed.select(F.col(key), F.col("doc_id").alias("_id")).join(groups, key)
    firsts = named.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", key)).alias("first"))
    return keyed.join(firsts.select(F.col(f"first.{key}").alias(key)), key, "left_semi").select(*docs.columns)
