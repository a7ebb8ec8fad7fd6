"""Captured payloads of hosted repositories: a listing with base64 contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leaksieve.functions.text import decode_base64, decode_strict
from leaksieve.operators.files import HOSTED_EXCLUDED_DIRS, outside_excluded_dirs, scannable_hosted_name

PAYLOAD_SCHEMA = ("repo string, default_branch string, ref string, type string, path string, name string, "
                  "content_b64 string")

# Fixed value: the branch scanned when neither caller nor repository names one.
FALLBACK_BRANCH = "main"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the columns of ``PAYLOAD_SCHEMA``."""
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)


def on_branch(payloads: DataFrame, branch: str | None = None) -> DataFrame:
    """Entries of ``branch``, else of each repository's default branch."""
    default: Column = F.col("default_branch") if "default_branch" in payloads.columns else F.lit(None)
    wanted = F.coalesce(F.lit(branch).cast("string"), default, F.lit(FALLBACK_BRANCH))
    return payloads.where(F.col("ref") == wanted)


def select_payloads(payloads: DataFrame) -> DataFrame:
    """File entries outside the excluded directories whose names are to be scanned."""
    return payloads.where(
        (F.col("type") == "file")
        & outside_excluded_dirs(F.col("path"), HOSTED_EXCLUDED_DIRS)
        & scannable_hosted_name(F.col("name")))


def decode_payloads(payloads: DataFrame) -> DataFrame:
    """Replaces ``content_b64`` by ``text``, null where it is empty, not base64 or not UTF-8."""
    payload = F.when(F.length("content_b64") > 0, F.col("content_b64"))
    decoded = payloads.withColumn("__bytes", decode_base64(payload))
    return decoded.withColumn("text", decode_strict(F.col("__bytes"))).drop("content_b64", "__bytes")
