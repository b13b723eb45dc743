"""Reading leg and companion tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanelytics.sources.schema import conform_legs


def read_legs(spark: SparkSession, path: str, allow_missing: Collection[str] = ()) -> DataFrame:
    """Legs from Parquet; only referenced columns are read."""
    return conform_legs(spark.read.parquet(path), allow_missing)


def read_jdbc(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    partition_column: str,
    lower_bound: str,
    upper_bound: str,
    num_partitions: int,
) -> DataFrame:
    """A server table read in parallel slices of a numeric or date column.

    Connection details are the caller's; nothing is looked up here.
    """
    return (
        spark.read.format("jdbc")
        .options(**options)
        .option("dbtable", table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower_bound)
        .option("upperBound", upper_bound)
        .option("numPartitions", num_partitions)
        .load()
    )


def run_sql(
    spark: SparkSession,
    text: str,
    args: Mapping[str, Any] | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Run SQL over named DataFrames with bound parameters.

    Tables are referred to as ``{name}`` and parameters as ``:name``, so no
    user text is ever spliced into the statement.
    """
    return spark.sql(text, args=dict(args or {}), **tables)


def json_codes(text: Column) -> Column:
    """A JSON array held as text, as an array of strings; bad text gives NULL."""
    return F.from_json(text, "array<string>")


def explode_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """One row per element of a JSON array column; rows without elements drop out."""
    return df.withColumn(code, F.explode(json_codes(F.col(column)))).drop(column)
