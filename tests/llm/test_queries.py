import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from leaksieve.llm.bpe import encoding_digests
from leaksieve.llm.line_dedup import dedup_lines
from leaksieve.llm.ngram_join import ngram_groups
from leaksieve.llm.packing import pack_documents
from leaksieve.llm.quality_rules import quality_rules
from leaksieve.llm.queries import ORACLES, QUERIES, VOCABULARY_SIZE, vocabulary
from leaksieve.llm.sharding import shard_slots
from leaksieve.llm.token_files import token_file_digests
from tests.check_oracle import compare, connect
from tests.conftest import SF_DIR
from tests.llm.data import odd_frame


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    n, difference, _ = compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLES[name])
    assert difference is None and n > 0


def test_registered():
    names = set(registered.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def _digest(frame):
    return sorted(map(repr, frame.collect()))


CLASHING = ("key", "node", "tkey", "id", "n_shingles", "component_id", "n_tokens", "start", "ids_crc32", "ids_sha256", "piece", "length", "offset",
            "sequence_id", "print", "window", "part", "n", "mask", "shard", "bucket", "place", "_row", "_key", "score", "held_out", "predicted", "kept")


@pytest.mark.parametrize("operator", [
    lambda docs: ngram_groups(docs, 4, 85), lambda docs: encoding_digests(docs, vocabulary()), lambda docs: shard_slots(docs, bucket_bytes=1000),
    lambda docs: token_file_digests(docs, vocabulary(), VOCABULARY_SIZE, end_id=2),
    lambda docs: pack_documents(docs, vocabulary(), 512, 1).drop("sequence_id", "offset"), dedup_lines, quality_rules])
def test_columns_of_any_name_change_nothing(spark, operator):
    docs = odd_frame(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).drop("key", "score").orderBy("doc_id").coalesce(1)
    clashing = docs
    for i, name in enumerate(CLASHING):
        clashing = clashing.withColumn(name, F.lit(i))
    assert _digest(operator(clashing)) == _digest(operator(docs))
