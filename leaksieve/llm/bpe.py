"""Byte-pair encoding and decoding in numpy, many words at a time.

The symbols of many words stand in one flat array. A round looks up every neighbouring pair by
binary search over the sorted keys of all mergeable pairs, finds each word's pair of lowest rank and merges
it everywhere in the word; words without a pair are done and leave. The number of rounds is the number of
different pairs that one word merges, whatever the number of words.

The vocabulary file's own normaliser and pre-tokenizer cut chunks into words; chunks are encoded once
per worker (``chunks``). Decoding looks each id's token up. One pass over the whole texts, without a shuffle.

Defined results: a null, empty or blank text has no ids and decodes to the empty text; special tokens that stand in a
text are their ids; repeated rows have equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leaksieve.llm.chunks import Encode, broadcast_vocabulary, encoded, worker_encoder

_NO_RANK = np.iinfo(np.int64).max


class PairMerger:
    """The merge table of a vocabulary, and the rounds."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.size = max(vocabulary.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        # A pair that is listed twice has its first rank.
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks, self.merged = first.astype(np.int64), merged[first]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after the last merge, and how many each word has. No word is empty."""
        done, done_of = [], []
        word = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            can = (self.keys[at] == pair) & (word[1:] == word[:-1])
            rank = np.append(np.where(can, self.ranks[at], _NO_RANK), _NO_RANK)
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            finished = lowest == _NO_RANK
            done.append(symbols[finished])
            done_of.append(word[finished])
            chosen = np.flatnonzero((rank == lowest) & ~finished)
            if not len(chosen):
                break
            # Of overlapping pairs (a run of one symbol) every second is merged, from the left.
            run = np.append(True, np.diff(chosen) != 1)
            nth = np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            chosen = chosen[nth % 2 == 0]
            symbols = symbols.copy()
            symbols[chosen] = self.merged[at[chosen]]
            stays = ~finished
            stays[chosen + 1] = False
            symbols, word = symbols[stays], word[stays]
        flat, owner = np.concatenate(done), np.concatenate(done_of)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))


def numpy_encode(vocabulary: str) -> Encode:
    """Chunks to ids by merge rounds."""
    from tokenizers import Tokenizer  # for the file's normaliser and pre-tokenizer

    spec = json.loads(vocabulary)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokenizer = Tokenizer.from_str(vocabulary)
    normalise, cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
    ids, ending = model["vocab"], model.get("end_of_word_suffix") or ""
    merger = PairMerger(ids, model["merges"])
    split = re.compile("(" + ("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)") + ")")

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        symbols, sizes, owner = [], [], []
        for i, chunk in enumerate(chunks):
            text = chunk.decode("utf-8")
            for part in split.split(text):
                if part in special:
                    symbols.append(special[part])
                    sizes.append(1)
                    owner.append(i)
                    continue
                for word, _ in cut(normalise(part)):
                    own = [ids[c] for c in word[:-1]]
                    own.append(ids[word[-1] + ending])
                    symbols += own
                    sizes.append(len(own))
                    owner.append(i)
        if not sizes:
            return np.zeros(0, np.uint32), np.zeros(len(chunks), np.int64)
        flat, left = merger.merge(np.array(symbols, np.int64), np.array(sizes, np.int64))
        return flat.astype(np.uint32), np.bincount(owner, left, len(chunks)).astype(np.int64)
    return encode


def token_texts(vocabulary: str) -> np.ndarray:
    """Each id's token in UTF-8."""
    spec = json.loads(vocabulary)
    named = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    texts = np.full(max(named.values()) + 1, b"", object)
    for text, i in named.items():
        texts[i] = text.encode("utf-8")
    return texts


def decode(ids: np.ndarray, texts: np.ndarray) -> bytes:
    """Tokens joined by spaces: the library's decode for a file without a decoder."""
    return b" ".join(texts[ids].tolist())


def _digests(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, texts = worker_encoder("numpy", vocabulary, numpy_encode), token_texts(vocabulary.value)
        for batch in batches:
            sizes, of_ids, of_text = [], [], []
            for first, last, ids, bounds in encoded(batch.column("text"), encoder):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    sizes.append(b - a)
                    of_ids.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(decode(ids[a:b], texts)).hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})
    return run


def _encode_rows(vocabulary):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder("numpy", vocabulary, numpy_encode)
        for part in parts:
            found = [(ids, bounds) for _, _, ids, bounds in encoded(part, encoder)]
            sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(b) for _, b in found)])
            flat = np.concatenate([np.zeros(0, np.uint32), *(i for i, _ in found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))
    return run


def _decode_rows(vocabulary):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        texts = token_texts(vocabulary.value)
        for part in parts:
            yield pa.array([decode(np.array(row.as_py() or [], np.int64), texts).decode("utf-8") for row in part], pa.string())
    return run


def encode_column(docs: DataFrame, vocabulary_path: str, text: str = "text"):
    """A column of the ids of a text column, as an array of ints."""
    run = _encode_rows(broadcast_vocabulary(docs, vocabulary_path))
    return F.arrow_udf(run, "array<int>", F.ArrowUDFType.SCALAR_ITER)(F.col(text).cast("string"))


def decode_column(docs: DataFrame, vocabulary_path: str, ids: str):
    """A column of the texts of an id column."""
    run = _decode_rows(broadcast_vocabulary(docs, vocabulary_path))
    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(F.col(ids).cast("array<int>"))


def encoding_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row of ``docs`` (doc_id, text)."""
    vocabulary = broadcast_vocabulary(docs, vocabulary_path)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
