"""Token ids of many texts, for tokenizers that lower-case and never merge across white space.

A text is cut into chunks at ASCII white space, and before a full stop or comma after an ASCII letter, where
every pre-tokenizer of this kind cuts too. Every different chunk is encoded once per task, and the ids of
texts are gathered from the chunks' ids with numpy. Chunks are told apart by 64-bit hashes. ``encode`` may be any
function from chunks to ids. The memory of chunks is bounded: it is emptied when it is full.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leaksieve.llm.arrays import blocks, buffers, words
from leaksieve.llm.shared import python_ready

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]

#: Bytes of text that are cut into chunks at a time.
TEXT_BLOCK = 2 << 20

_encoders: dict[tuple[str, int], Encode] = {}


class ChunkIds:
    """``encode`` returns the ids of all its chunks in one array, and how many each chunk has."""

    def __init__(self, encode: Encode, chunks: int = 1 << 19, ids: int = 1 << 22):
        self.encode, self.most_chunks, self.most_ids = encode, chunks, ids
        self.forget()

    def forget(self) -> None:
        # Known chunks in order of hash: where their ids begin, and how many there are.
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        ids, sizes = self.encode(chunks)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.begins = np.insert(self.begins, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.used += len(ids)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of consecutive texts, and where each text's begin, with one more entry at the end."""
        if len(self.hashes) > self.most_chunks or self.used > self.most_ids:
            self.forget()
        part = data[int(offsets[0]):int(offsets[-1])]
        raw = part.tobytes()
        if b"<|" not in raw:  # a special token in capitals is none
            raw = raw.lower()
        hashes, bounds, first = words(np.frombuffer(raw, np.uint8), offsets - offsets[0], cut_stops=True)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        different, place, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        known = np.zeros(len(different), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == different[inside]
        if not known.all():
            unknown = np.flatnonzero(~known)
            self._learn(different[unknown], [raw[a:b] for a, b in bounds[place[unknown]].tolist()])
            at = np.searchsorted(self.hashes, different)
        at = at[back]
        begins, sizes = self.begins[at], self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[first]


def encoded(column: pa.Array, encoder: ChunkIds) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, bounds) of blocks of a string column."""
    data, offsets = buffers(column)
    for first, last in blocks(offsets, TEXT_BLOCK):
        yield first, last, *encoder.of(data, offsets[first:last + 1])


def broadcast_vocabulary(docs: DataFrame, path: str):
    """The tokenizer file at ``path`` on the driver (its size does not depend on the data), for the workers."""
    with open(path, encoding="utf-8") as file:
        return python_ready(docs).sparkSession.sparkContext.broadcast(file.read())


def worker_encoder(kind: str, vocabulary, make: Callable[[str], Encode]) -> ChunkIds:
    """A task's encoder for a broadcast vocabulary. The worker keeps the tokenizer for later tasks, but not the chunks."""
    key = kind, hash(vocabulary.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = make(vocabulary.value)
    return ChunkIds(_encoders[key])


def library_encode(vocabulary: str) -> Encode:
    """Chunks to ids by the tokenizers library, single-threaded as Spark has a task per core.

    The library is quicker with one text of many chunks than with many short texts. The bytes that
    tokens stand for tell where each chunk ends. Chunks whose normal form (composed, lower-cased) has other
    bytes, or that hold a special token, are encoded one by one with their neighbours.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    named, ending = tokenizer.get_vocab(with_added_tokens=True), json.loads(vocabulary)["model"].get("end_of_word_suffix") or ""
    stands_for = np.zeros(max(named.values()) + 1, np.int64)
    for token, i in named.items():
        # A byte is one character of a token's text.
        stands_for[i] = len(token.removesuffix(ending)) if ending else len(token)

    def run(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def one_by_one(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = run([c.decode("utf-8") for c in chunks])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def together(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(chunks)
        text, sizes = joined.decode("utf-8"), list(map(len, chunks))
        if b"<|" in joined or not text.isascii() and not (
                unicodedata.is_normalized("NFC", text) and len(text.split()) == len(chunks)
                and list(map(len, text.lower().encode("utf-8").split(b" "))) == sizes):
            return one_by_one(chunks)
        ids = np.array(run([text])[0], np.uint32)
        ends, wanted = np.cumsum(stands_for[ids]), np.cumsum(sizes)
        last = np.searchsorted(ends, wanted)
        if len(ids) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
            return ids, np.diff(last, prepend=-1)
        return one_by_one(chunks)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [together(chunks[a:a + 512]) for a in range(0, len(chunks), 512)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    return encode
