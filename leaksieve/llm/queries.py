"""The registered queries of the subpackage, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from leaksieve.llm import sql
from leaksieve.llm.bpe import encoding_digests
from leaksieve.llm.conversation_repair import repair_conversations
from leaksieve.llm.filter_audit import filter_interactions
from leaksieve.llm.html_text import extract_text
from leaksieve.llm.line_dedup import dedup_lines
from leaksieve.llm.nearest import nearest
from leaksieve.llm.ngram_join import ngram_groups
from leaksieve.llm.packing import pack_documents
from leaksieve.llm.quality_classifier import classify_quality
from leaksieve.llm.quality_rules import quality_rules
from leaksieve.llm.sharding import shard_slots
from leaksieve.llm.token_files import token_file_digests
from leaksieve.llm.toxicity import classify_toxicity

#: Ids of the vocabulary below, special tokens included.
VOCABULARY_SIZE = 49408


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(_read(spark, sf_dir, "documents"), size=4, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(_read(spark, sf_dir, "documents"), vocabulary())


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(_read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(_read(spark, sf_dir, "documents"), vocabulary(), VOCABULARY_SIZE, end_id=2)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_read(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_quality_rules, op3_bpe, op4_nearest_neighbours, op5_sharding, op6_token_files,
    op7_best_fit_packing, op8_toxicity, op9_quality_classifier, op10_line_dedup,
    op11_html_extraction, op12_conversation_repair, op13_filter_audit)}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.NGRAM_GROUPS,
    "op2_quality_rules": sql.QUALITY_RULES,
    "op13_filter_audit": sql.FILTER_AUDIT,
}
