"""Properties of plans and tables that matter at scale."""

import re

from leaksieve.llm.quality_rules import quality_rules
from leaksieve.llm.shared import bucketed, discard, recorded_folders, written
from leaksieve.llm.sharding import shard_slots
from tests.llm.data import odd_frame


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark):
    for frame in (quality_rules(odd_frame(spark)), shard_slots(odd_frame(spark))):
        assert not re.search("Python|Pandas|Arrow", plan(frame))


def test_joins_do_not_move_a_bucketed_table(spark):
    sets = bucketed(spark.range(1000).selectExpr("id AS node", "cast(id AS string) AS grams"), "node")
    pairs = spark.range(50).selectExpr("id AS a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(pairs.join(sets.withColumnRenamed("node", "a"), "a"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1
    discard(sets)


def test_folders_are_recorded_and_deleted(spark):
    with recorded_folders() as folders:
        table = written(spark.range(3))
    assert len(folders) == 1 and table.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(folders[0])
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(path)
    discard(table)
    assert not system.exists(path)
