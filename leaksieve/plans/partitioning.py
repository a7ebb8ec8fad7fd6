"""Input partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    """The input in ``partitions`` even partitions, or as Spark reads it.

    Worth a shuffle of the texts only where the caller knows that files have too few splits, as
    tables of one row group have.
    """
    return df if partitions is None or df.isStreaming else df.repartition(partitions)
