"""Run every report in Spark and in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.registry import queries

TEST_TABLES = "region nation customer supplier part orders lineitem".split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TEST_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple(
        (value is not None, f"{value:.4f}" if isinstance(value, float) else str(value)) for value in row
    )


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def difference(spark: SparkSession, connection, name: str, sf_dir: str) -> tuple[str | None, int]:
    """What differs between the engines, or None, and the number of rows."""
    frame = queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted([tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()], key=_sortable)
    cursor = connection.execute(ORACLE[name])
    named = [d[0] for d in cursor.description]
    if sorted(named) != columns:
        return f"columns {columns} != {sorted(named)}", len(got)
    order = [named.index(c) for c in columns]
    want = sorted([tuple(r[i] for i in order) for r in cursor.fetchall()], key=_sortable)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got)
    for a, b in zip(got, want):
        wrong = [c for c, x, y in zip(columns, a, b) if not _same(x, y)]
        if wrong:
            return f"{wrong}: {a} != {b}", len(got)
    return None, len(got)


def main(sf_dir: str, names: list[str]) -> int:
    from checks.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for name in names or list(ORACLE):
        begun = time.time()
        try:
            wrong, rows = difference(spark, connection, name, sf_dir)
        except Exception as error:  # one broken report must not hide the others
            wrong, rows = f"{type(error).__name__}: {str(error)[:500]}", 0
        failed += wrong is not None
        print(f"{name:36s} {rows:7d} rows {time.time() - begun:6.2f} s  {wrong or 'ok'}"[:700], flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
