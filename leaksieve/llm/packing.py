"""Best-fit packing of documents into sequences, by bin completion.

A sequence is begun by the largest piece left; its completions are searched depth-first among the other
pieces, fullest first, and only those that no other dominates (a filling to which a further piece could be
added, or whose pieces are no larger than another's place by place, is dominated). The search backtracks
over completions as long as the waste so far leaves room for fewer sequences than the incumbent's;
the first incumbent is the best-fit decreasing packing. It ends at the lower bound (``least_bins``), when all
completions have been tried, or after ``NODES`` of them. A sequence's completions are cut off after some at first, the
largest pieces first; as long as nodes are left and something was cut off, the search begins anew with ``WIDER`` times as many.

Pieces are dealt out evenly, whatever their keys, to tasks of about ``GROUP`` pieces; each task packs its own. Only lengths
and ids go to the packing; the texts are read once, by the encoder. How far from the bound a packing may end depends on the
lengths: with many short ones it reaches it, with lengths about a third of the capacity it may not.

Defined results: a null or empty text is its end id alone; a text of more ids than the capacity is cut into
pieces of exactly the capacity and a rest; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from leaksieve.llm.chunks import broadcast_vocabulary, encoded, library_encode, worker_encoder
from leaksieve.llm.shared import tidy, written

#: Pieces that one task packs, about. A piece is one narrow row.
GROUP = 1 << 14
#: Completions tried for one sequence at first, by how many times more in each further search, and in all searches of one task.
FILLINGS, WIDER, NODES = 64, 8, 40000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths; ``lengths`` descend."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for length in lengths:
        at = bisect_left(room, (length, -1))
        if at == len(room):
            bins.append([length])
            left, which = capacity - length, len(bins) - 1
        else:
            left, which = room.pop(at)
            bins[which].append(length)
            left -= length
        if left:
            insort(room, (left, which))
    return bins


class Stock:
    """Pieces left, by length."""

    def __init__(self, lengths: list[int]):
        self.counts: dict[int, int] = {}
        for length in lengths:
            self.counts[length] = self.counts.get(length, 0) + 1
        self.sizes = sorted(self.counts)
        self.left = len(lengths)

    def take(self, *lengths: int) -> None:
        for length in lengths:
            self.counts[length] -= 1
            if not self.counts[length]:
                self.sizes.pop(bisect_left(self.sizes, length))
        self.left -= len(lengths)

    def put_back(self, *lengths: int) -> None:
        for length in lengths:
            if not self.counts[length]:
                insort(self.sizes, length)
            self.counts[length] += 1
        self.left += len(lengths)


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound on the bins that descending ``lengths`` need.

    The whole content; and for each smallest length that counts, the pieces above half, which need a bin each, with what the
    others overflow the room beside those that leave some (Martello and Toth).
    """
    sizes = np.array(lengths[::-1], np.int64)
    if not len(sizes):
        return 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    bound = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    least = np.unique(np.concatenate([[0], sizes[:half]]))
    at = np.searchsorted(sizes, least)
    # Pieces beside which not even the smallest that counts fits.
    alone = np.maximum(np.searchsorted(sizes, capacity - least, side="right"), half)
    beside = (alone - half) * capacity - (total[alone] - total[half])
    over = np.maximum(0, -(-(total[half] - total[at] - beside) // capacity))
    return max(bound, int((len(sizes) - half + over).max()))


def fillings(stock: Stock, room: int, most: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated sets of pieces for ``room``, the fullest first, and whether some were cut off after ``most``.

    One that leaves nothing ends the search: it dominates all others.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    tries, chosen, cut = 0, [], False

    def search(left: int, top: int) -> bool:
        nonlocal tries, cut
        fits = False
        for at in range(bisect_right(stock.sizes, left, 0, top) - 1, -1, -1):
            size = stock.sizes[at]
            if stock.counts[size] > chosen.count(size):
                fits = True
                chosen.append(size)
                ended = search(left - size, at + 1)
                chosen.pop()
                if ended:
                    return True
        if fits:
            return False
        tries += 1
        # With nothing smaller that fits, the set is dominated only if something larger still does.
        if not any(stock.counts[s] > chosen.count(s) for s in stock.sizes[:bisect_right(stock.sizes, left)]):
            found.append((left, tuple(chosen)))
        cut = cut or (left > 0 and tries >= most)
        return not left or tries >= most

    search(room, len(stock.sizes))
    found.sort(key=lambda f: f[0])
    kept: list[tuple[int, ...]] = []
    for _, filling in found:
        if not any(len(o) == len(filling) and all(x >= y for x, y in zip(o, filling)) for o in kept):
            kept.append(filling)
    return kept, cut


def complete_bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """A packing of ``lengths`` (each at most ``capacity``) into few bins."""
    lengths = sorted(lengths, reverse=True)
    best = best_fit_decreasing(lengths, capacity)
    bound, most, nodes = least_bins(lengths, capacity), FILLINGS, 0
    while len(best) > bound and nodes < NODES + len(lengths):
        best, nodes, cut = _search(lengths, capacity, best, bound, most, nodes)
        if not cut:
            break
        most *= WIDER
    return best


def _search(lengths: list[int], capacity: int, best: list[list[int]], bound: int, most: int, nodes: int) -> tuple[list[list[int]], int, bool]:
    """The best packing that a search with ``most`` completions of a sequence finds, the nodes used, and whether it was not exhaustive."""
    total = sum(lengths)
    stock, waste, cut = Stock(lengths), 0, False
    # The bins so far: first piece, completion in place, completions not yet tried.
    bins: list[tuple[int, tuple[int, ...], list[tuple[int, ...]]]] = []

    def place(first: int, options: list[tuple[int, ...]]) -> bool:
        """Puts the first completion in place that leaves room for fewer bins than the incumbent's."""
        nonlocal waste
        while options:
            filling = options.pop(0)
            lost = capacity - first - sum(filling)
            if waste + lost <= (len(best) - 1) * capacity - total:
                stock.take(first, *filling)
                waste += lost
                bins.append((first, filling, options))
                return True
        return False

    while len(best) > bound and nodes < NODES + len(lengths):
        nodes += 1
        if stock.left:
            first = stock.sizes[-1]
            stock.take(first)
            options, some = fillings(stock, capacity - first, most)
            cut = cut or some
            # Completions of wider searches cost as many nodes more.
            nodes += most // FILLINGS - 1
            stock.put_back(first)
            if place(first, options):
                continue
        else:
            best = [[first, *filling] for first, filling, _ in bins]
        # No bin can follow within the bound: the latest bin with another completion takes it.
        while bins:
            first, filling, options = bins.pop()
            stock.put_back(first, *filling)
            waste -= capacity - first - sum(filling)
            if place(first, options):
                break
        else:
            return best, nodes, cut
    return best, nodes, cut


def _pieces(vocabulary, end_id: int | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder("library", vocabulary, library_encode)
        for batch in batches:
            names = batch.column("doc_id")
            rows, piece, start, length, crc = [], [], [], [], []
            for first, last, ids, bounds in encoded(batch.column("text"), encoder):
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                ids = ids.astype("<u4")
                for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), first):
                    for k, at in enumerate(range(a, b, capacity)):
                        end = min(at + capacity, b)
                        rows.append(row)
                        piece.append(k)
                        start.append(at - a)
                        length.append(end - at)
                        crc.append(zlib.crc32(ids[at:end].tobytes()))
            yield pa.record_batch({
                "doc_id": names.take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
    return run


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        length = table.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        ranked = length[order]
        # The pieces of each length, from which bins of lengths are filled.
        sizes, begin = np.unique(ranked, return_index=True)
        following = dict(zip(sizes.tolist(), begin.tolist()))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        base = TaskContext.get().partitionId() << 32
        for number, filled in enumerate(complete_bins(ranked.tolist(), capacity)):
            at = 0
            for size in filled:
                row = order[following[size]]
                following[size] += 1
                sequence[row], offset[row] = base + number, at
                at += size
        yield pa.RecordBatch.from_arrays(
            [*(c.chunk(0) for c in table.columns), pa.array(sequence), pa.array(offset)], names=[*table.column_names, "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 4096, end_id: int | None = 1) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): its place in the document, and its sequence and place there."""
    vocabulary = broadcast_vocabulary(docs, vocabulary_path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(texts.mapInArrow(tidy(_pieces(vocabulary, end_id, capacity)), _PIECES))
    groups = max(1, -(-pieces.count() // GROUP))
    # Dealt out in turn, not by a key: no key's rows meet in one task, and every task gets its GROUP pieces.
    return pieces.repartition(groups).mapInArrow(_pack(capacity), f"{_PIECES}, sequence_id long, offset long")
