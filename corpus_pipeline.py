"""From raw documents to training sequences: five stages, each an operator of ``leaksieve.llm``.

Every stage works on all that the one before it kept. All but the last return the columns of ``documents``;
the last returns one row per piece of a document, with its sequence and place there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from leaksieve.llm.line_dedup import keep_first_lines
from leaksieve.llm.ngram_join import keep_first_of_group
from leaksieve.llm.packing import pack_documents
from leaksieve.llm.quality_classifier import keep_by_quality
from leaksieve.llm.quality_rules import keep_by_rules
from leaksieve.llm.queries import vocabulary
from leaksieve.llm.samples import remainder
from leaksieve.llm.shared import delete_folders, discard, recorded_folders, written

_kept: dict[str, list[str]] = {}


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the tables that operators keep for the stage before it are deleted.

    A stage gets what the one before it returned, written and read again, so those tables have been used by then.
    """
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application, inputs = spark.sparkContext.applicationId, docs.inputFiles()
        delete_folders(spark, [f for f in _kept.pop(application, []) if not any(f in name for name in inputs)])
        with recorded_folders() as folders:
            result = work(spark, docs, sf_dir)
        _kept[application] = folders
        return result
    return run_stage



@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below 0.5."""
    return keep_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(3) != 1)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose host is rejected."""
    return keep_by_rules(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated passages from later documents; documents that consist of them go."""
    return keep_first_lines(docs)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words, a similarity of 0.8 or more."""
    return keep_first_of_group(docs, size=5, percent=80)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of the documents into sequences of at most 4096."""
    return pack_documents(docs, vocabulary(), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier decides what the first stage keeps; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written in the shared folder and read again."""
    docs, previous = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if previous is not None:
            discard(previous)
        previous = docs
    return docs
