"""Scans of tables in which many texts are copies: each distinct text is matched once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leaksieve.plans.partitioning import dealt
from leaksieve.plans.scan import scan_text
from leaksieve.plans.scratch import scratch_dir
from leaksieve.rules import RuleSet

#: Copies of one text that are joined to its findings in one part, at least.
PART_ROWS = 1 << 16


def scan_copies(df: DataFrame, text: str, rules: RuleSet | None = None, *, partitions: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """The findings of ``scan_text``, from one match per distinct text.

    Texts are addressed by their SHA-256. The distinct ones are written once, with the number of their copies; copies in one
    partition meet before the shuffle. Findings go back to all rows of their text by a join on the hash, in which only rows
    without text move. A text whose copies are more than ``part_rows``, and a thousandth of all rows, would make one task of the
    join: its findings are repeated for parts of its copies. Runs the first half when called; the table is read twice.
    """
    names = [c for c in df.columns if c != text]
    digest = F.unhex(F.sha2(F.col(f"`{text}`").cast("string").cast("binary"), 256))
    df = dealt(df, partitions).where(F.col(f"`{text}`").isNotNull())
    folder = f"{scratch_dir(df.sparkSession)}/texts"
    distinct = df.select(digest.alias("__hash"), F.col(f"`{text}`").alias("__text"))
    distinct.groupBy("__hash").agg(F.count("*").alias("__n"), F.first("__text").alias("__text")).write.parquet(folder)
    distinct = df.sparkSession.read.parquet(folder)
    limit = max(part_rows, (distinct.agg(F.sum("__n")).first()[0] or 0) >> 10)
    # Fewer than 1,024, as each has more than a 1,024th of all rows.
    many = distinct.where(F.col("__n") > limit).select("__hash", F.ceil(F.col("__n") / limit).cast("long").alias("__parts")).collect()
    many = F.broadcast(df.sparkSession.createDataFrame(many, "__hash binary, __parts long"))

    found = scan_text(distinct.select("__hash", "__text"), "__text", rules)
    results = [c for c in found.columns if c != "__hash"]
    found = found.join(many, "__hash", "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    # Any part will do for a row, as each has all findings.
    rows = df.select(*[F.col(f"`{c}`") for c in names], digest.alias("__hash")).join(many, "__hash", "left")
    rows = rows.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    return rows.join(found, ["__hash", "__part"]).select(*[F.col(f"`{c}`") for c in names], *results)
