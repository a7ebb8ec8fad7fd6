import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaksieve.llm import packing, token_files
from leaksieve.llm.bpe import decode_column, encode_column, encoding_digests
from leaksieve.llm.packing import best_fit_decreasing, complete_bins, least_bins, pack_documents
from leaksieve.llm.samples import labelled_sample
from leaksieve.llm.token_files import TokenFile, bits_for, pack, read_token_files, unpack, write_token_files
from tests.llm.data import empty_frame, odd_frame

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module", params=["odd", "given"])
def frame(request, spark):
    return odd_frame(spark) if request.param == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_encoding_equals_the_library(frame):
    expected = Counter()
    for r in frame.collect():
        ids = ids_of(r.text)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        expected[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in encoding_digests(frame, PATH).collect()) == expected


def test_columns(spark):
    frame = odd_frame(spark).select("doc_id", "text", encode_column(odd_frame(spark), PATH).alias("ids"))
    rows = frame.withColumn("back", decode_column(frame, PATH, "ids")).collect()
    assert all(r.ids == ids_of(r.text) and r.back == LIBRARY.decode(r.ids, skip_special_tokens=False) for r in rows)


@pytest.mark.parametrize("bits", [1, 5, 12, 16, 17, 32])
def test_packed_ids_come_back(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10001).astype(np.uint32)
    assert (unpack(pack(ids, bits), bits, len(ids)) == ids).all()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_token_files(spark, frame, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    manifest = write_token_files(frame, PATH, 49408, 2).cache()
    rows = read_token_files(manifest).collect()
    expected = Counter()
    for r in frame.collect():
        ids = np.array([*ids_of(r.text), 2], "<u4")
        expected[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    names = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert names == sorted(names)
    # Random access: a document from its blocks alone.
    largest = max(manifest.collect(), key=lambda m: m.n_ids)
    file = TokenFile(largest.path)
    last = file.n_docs - 1
    text = next(r.text for r in frame.collect() if r.doc_id == file.doc_ids[last])
    assert file.document(last)[-1] == 2
    if not file.named[last] or text is not None:
        assert len(file.document(last)) > 0


def fewest(items, capacity):
    """The fewest bins that an exhaustive search finds."""
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
        put(i + 1, [*bins, items[i]])
    put(0, [])
    return best


def test_small_bins_are_optimal():
    """Against the fewest bins that an exhaustive search finds."""
    rng = np.random.default_rng(1)

    for _ in range(60):
        capacity = int(rng.integers(20, 60))
        items = sorted(rng.integers(1, capacity + 1, 11).tolist(), reverse=True)
        bins = complete_bins(items, capacity)
        assert sorted(x for b in bins for x in b) == sorted(items) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == fewest(items, capacity)
    # A case that best fit decreasing packs into three.
    assert len(best_fit_decreasing([5, 4, 4, 3, 2, 2], 10)) == 3
    assert len(complete_bins([5, 4, 4, 3, 2, 2], 10)) == 2


def test_packing(spark, frame, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rows = pack_documents(frame, PATH, 512, 1).collect()
    expected = Counter()
    for r in frame.collect():
        ids = [*ids_of(r.text), 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at:at + 512], "<u4")
            expected[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[-1][0] + own[-1][1] <= 512
        assert all(b[0] == a[0] + a[1] for a, b in zip(own, own[1:])) and own[0][0] == 0
    total = sum(r.length for r in rows)
    assert len(places) <= 1.05 * total / 512 + 8


def test_empty_table(spark):
    empty = empty_frame(spark)
    assert encoding_digests(empty, PATH).collect() == []
    assert read_token_files(write_token_files(empty, PATH, 49408, 2)).collect() == []
    assert pack_documents(empty, PATH).collect() == []


def test_packings_are_the_best_ones(monkeypatch):
    """Small cases, also where completions are cut off at first; and the bound is one."""
    rng = random.Random(5)
    for first in (64, 1):
        monkeypatch.setattr(packing, "FILLINGS", first)
        for _ in range(150):
            capacity = rng.choice([20, 50, 100])
            lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(capacity // 4, capacity // 2 + 1)
                       for _ in range(rng.randrange(0, 11))]
            bins = complete_bins(lengths, capacity)
            assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= capacity for b in bins)
            least = least_bins(sorted(lengths, reverse=True), capacity)
            assert least <= fewest(lengths, capacity) == len(bins)
    assert least_bins([60, 60, 60], 100) == 3 and least_bins([70, 70, 35, 35], 100) == 3


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(200)] + [(500, None), (501, "y" * 70000)], "doc_id long, text string")
    labels = docs.where("doc_id < 200").selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    whole = labelled_sample(docs, labels, "toxic", F.lit(True), 150)
    assert whole.num_rows == 150
    part = labelled_sample(docs, labels, "toxic", F.lit(True), 150, max_bytes=20_500)
    assert part.num_rows == 20 and part.column("key").to_pylist() == whole.column("key").to_pylist()[:20]
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 150, max_bytes=10).num_rows == 0
