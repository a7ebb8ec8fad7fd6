"""Compares every registered query with its SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from workload.tables import GIVEN  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in GIVEN:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in values), key=repr)


def compare(spark, connection, sf_dir, name, function, sql):
    frame = function(spark, sf_dir)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return len(got), None, None
    result = connection.sql(sql)
    expected = rows(result.columns, result.fetchall())
    types = sorted(zip(frame.columns, [f.dataType.simpleString() for f in frame.schema])), \
        sorted(zip(result.columns, map(str, result.types)))
    difference = None
    if sorted(frame.columns) != sorted(result.columns):
        difference = f"columns {frame.columns} / {result.columns}"
    elif got != expected:
        first = next(((a, b) for a, b in zip(got, expected) if a != b), None)
        difference = f"{len(got)} / {len(expected)} rows; first difference {first}"
    return len(got), difference, types


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    database, oracles = connect(sf), registered.oracle_sql()
    failed = 0
    for key, call in registered.queries().items():
        if sys.argv[2:] and key not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            n, problem, kinds = compare(session, database, sf, key, call, oracles.get(key))
        except Exception as exc:  # report and go on with the next query
            n, problem, kinds = -1, f"{type(exc).__name__}: {str(exc)[:1500]}", None
        if kinds:
            names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
            odd = [(a, b[1]) for a, b in zip(*kinds) if names.get(a[1], a[1]) != b[1]]
            problem = problem or (f"types {odd}" if odd else None)
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    sys.exit(1 if failed else 0)
