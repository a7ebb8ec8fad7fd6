import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from leaksieve.llm import ngram_join
from leaksieve.llm.components import components
from leaksieve.llm.ngram_join import may_link, ngram_groups, sketch
from leaksieve.llm.shared import written
from tests.llm.data import empty_frame, odd_frame, words

SCHEMA = "doc_id long, text string"


def brute_force(rows, size=4, percent=85):
    """(n_shingles, component) per row, by comparing all pairs of rows that share a gram."""
    sets = []
    for _, text in rows:
        w = words(text, lower=True)
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, grams in enumerate(sets):
        shared = Counter(j for g in grams for j in holders[g])
        for j, both in shared.items():
            if 100 * both >= percent * (len(grams) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for g in grams:
            holders[g].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[root(i)] if rows[j][0] is not None]
        found.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return found


def check(spark, rows):
    got = [tuple(r) for r in ngram_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert Counter(got) == Counter(brute_force(rows))


def test_odd_rows(spark):
    frame = odd_frame(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = [tuple(r) for r in ngram_groups(frame).collect()]
    assert Counter(got) == Counter(brute_force(rows))


def test_empty_table(spark):
    assert ngram_groups(empty_frame(spark)).collect() == []


def near_copies():
    """A large group of near copies, chains of them, and texts of few grams around the threshold."""
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(120):
        changed = list(base)
        changed[i % 55] = f"c{i}"
        rows.append(" ".join(changed))
    for step in range(12):
        rows.append(" ".join(f"s{i + step}" for i in range(50)))
    for n in range(3, 14):
        rows.append(" ".join(f"u{i}" for i in range(n)))
        rows.append(" ".join(f"u{i}" for i in range(n)).upper())
    return list(enumerate(rows))


def test_near_copies(spark):
    check(spark, near_copies())


def test_lists_in_blocks(spark, monkeypatch):
    """With tiny blocks, every heavy list is split and the result is the same."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 8)
    check(spark, near_copies())


def test_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert Counter(tuple(r) for r in ngram_groups(frame).collect()) == Counter(brute_force([tuple(r) for r in frame.collect()]))


@pytest.mark.parametrize("links, expected", [
    ([], {}),
    ([(5, 5)], {}),
    ([(i, i + 1) for i in range(30)], {i: 0 for i in range(31)}),
    ([(9, i) for i in range(20, 40)] + [(3, 39), (50, 51)], {3: 3, 9: 3, **{i: 3 for i in range(20, 40)}, 50: 50, 51: 50}),
])
def test_components(spark, links, expected):
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(frame, "a", "b").collect()} == expected


@pytest.mark.parametrize("percent", [70, 50])
def test_small_sets_at_lower_percents(spark, percent):
    """Sets that link with fewer than ``OFTEN`` grams in common."""
    rows = [(i, " ".join(f"g{i // 2}w{j}" for j in range(4 + i // 2 % 4 + i % 2))) for i in range(24)]
    got = [tuple(r) for r in ngram_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=percent).collect()]
    assert Counter(got) == Counter(brute_force(rows, percent=percent))
    assert len({c for _, _, c in got}) < len(rows)


def test_no_table_stays_in_the_catalogue(spark):
    ngram_groups(odd_frame(spark), 4, 85).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_")]


def test_filter_lets_wanted_rows_pass(spark):
    """Bits of all wanted rows are set, and few others'; a small limit of bits only lets more pass."""
    ids = written(spark.range(0, 40000, 3).selectExpr("xxhash64(id) AS id"))
    others = np.array([r.id for r in spark.range(1, 40000, 3).selectExpr("xxhash64(id) AS id").collect()])
    wanted = np.array([r.id for r in ids.collect()])
    for limit, most in ((1 << 27, 0.02), (1 << 12, 1.0)):
        old, ngram_join.FILTER_BITS = ngram_join.FILTER_BITS, limit
        try:
            bits = np.unpackbits(ngram_join._filter_of(ids)).view(bool)
        finally:
            ngram_join.FILTER_BITS = old

        def passing(x):
            return np.logical_and.reduce([bits[p] for p in ngram_join._places(x, len(bits))])
        assert passing(wanted).all() and passing(others).mean() <= most


def test_lists_of_one_head_in_shares(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAD_ROWS", 8)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", 64)
    rng = random.Random(6)
    body = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{i}y{j}" for j, w in enumerate(body))) for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_groups(frame, 4, 85).collect()} == set(brute_force(rows, 4, 85))


def test_sketches_spare_pairs_that_do_not_link():
    """What two sets share is bounded from their sketches: no pair that links is lost, and few others are left."""
    draw = np.random.default_rng(5)
    lost = left = 0
    for m in (1, 3, 40, 400, 3_000, 20_000):
        whole = np.unique(draw.integers(0, 1 << 63, 2 * m, dtype=np.uint64))
        first = whole[:m]
        for shared in sorted({m, m - 1, m - m // 20, m - m // 14, m - m // 10, m // 2, m // 5}):
            for extra in (0, m // 12, m // 5):
                second = np.sort(np.concatenate([first[:shared], whole[m:m + extra]]))
                if not len(second):
                    continue
                links = 100 * shared >= 85 * (m + extra)
                passes = may_link(sketch(first), sketch(second), len(first), len(second), 85)
                lost += links and not passes
                left += passes and shared <= m // 2 and m > 3
    assert (lost, left) == (0, 0)
    assert len(sketch(whole)) < whole.nbytes / 10
