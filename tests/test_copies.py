import random

import pytest

from leaksieve.plans.copies import scan_copies
from leaksieve.plans.scan import scan_text


def copies(spark, n):
    rng = random.Random(2)
    texts = ["pwd = 'abcdefghij'\nnothing here\npwd = 'klmnopqrst'", "nothing at all", None, "", *[f"line one\npwd = 'secret-{i}'" for i in range(20)]]
    rows = [(i, texts[0] if i % 2 else rng.choice(texts), f"s{i % 3}") for i in range(n)] + [(5, texts[0], None), (None, texts[0], "s")]
    return spark.createDataFrame(rows, "id long, `te xt` string, source string").repartition(6)


@pytest.mark.parametrize("part_rows", [1, 40, 1 << 16])
def test_findings_are_those_of_a_plain_scan(spark, part_rows):
    docs = copies(spark, 400)
    found, expected = scan_copies(docs, "te xt", part_rows=part_rows), scan_text(docs, "te xt")
    assert found.columns == expected.columns and found.dtypes == expected.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    assert scan_copies(docs.limit(0), "te xt").collect() == []


def test_distinct_texts_alone_are_matched(spark, monkeypatch, tmp_path):
    from leaksieve.plans import copies as module

    monkeypatch.setattr(module, "scratch_dir", lambda spark: str(tmp_path))
    docs = copies(spark, 2000)
    found = scan_copies(docs, "te xt", part_rows=100)
    table = spark.read.parquet(str(tmp_path / "texts"))
    assert table.count() == docs.select("te xt").where("`te xt` IS NOT NULL").distinct().count() < docs.count() // 50
    assert table.agg({"__n": "sum"}).first()[0] == docs.where("`te xt` IS NOT NULL").count()
    # The join moves rows without their texts, and a frequent text's in parts.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == scan_text(docs, "te xt").count() and "__part" in plan
