"""Words, lines and hashes of Arrow string columns as flat numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+``. UTF-8 never has these bytes inside a character, so everything
works on the column's bytes. Memory is bounded by ``BLOCK`` bytes of text at a time, whatever the
size of a batch; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    values = values + np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


# One random number for each byte at each of 256 places in a word.
_PLACED = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 40))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the place where each text begins (one more at the end); null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text, or a single row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, cut_stops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte range of every word of consecutive texts, and where each text's words begin.

    Returns ``(hashes, bounds, first)``: ``bounds`` has a row (start, end) per word, ``first`` the
    index of each text's first word with one more entry at the end. ``cut_stops`` begins a word at a full
    stop or comma after an ASCII letter too.
    """
    base, stop = int(offsets[0]), int(offsets[-1])
    part = data[base:stop]
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[part]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1] - base
    edges = edges[edges < len(part)]
    begins[edges] = inside[edges]
    if cut_stops:
        begins[1:] |= ((part[1:] == 46) | (part[1:] == 44)) & _LETTER[part[:-1]]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(len(offsets), np.int64)
    # The bytes of words, without white space, are one run per word.
    kept = part[inside]
    if lower:
        kept = _LOWER[kept]
    at = (np.cumsum(inside, dtype=np.int64) - 1)[starts]
    lengths = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lengths)
    values = _PLACED[((place & 255) << 8) | kept]
    if lengths.max() > 256:
        values = values * (2 * (place >> 8) + 1).astype(np.uint64)
    hashes = mix(np.add.reduceat(values, at) + lengths.astype(np.uint64))
    bounds = np.column_stack([starts + base, starts + lengths + base])
    return hashes, bounds, np.searchsorted(starts, offsets - base)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed 64-bit integers that Spark holds."""
    return values.view(np.int64)


# White space, letters and digits (with all bytes beyond ASCII), other signs.
_KIND = np.where(_SPACE, 0, 2).astype(np.uint8)
_KIND[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, lower-cased, and of the runs of other signs; and where each text's begin."""
    base, stop = int(offsets[0]), int(offsets[-1])
    part = data[base:stop]
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _KIND[part]
    begins = kind > 0
    begins[1:] &= kind[1:] != kind[:-1]
    edges = offsets[:-1] - base
    edges = edges[edges < len(part)]
    begins[edges] = kind[edges] > 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = kind > 0
    kept = _LOWER[part[inside]]
    at = (np.cumsum(inside, dtype=np.int64) - 1)[starts]
    lengths = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lengths)
    values = _PLACED[((place & 255) << 8) | kept]
    if lengths.max() > 256:
        values = values * (2 * (place >> 8) + 1).astype(np.uint64)
    return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64)), np.searchsorted(starts, offsets - base)
