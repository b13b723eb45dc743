"""Changed legs, merged by key into stored enriched legs.

The stored legs are partitioned by delivery date, and a corrected leg may have
left the date that it was stored under.  An index beside the table tells the
dates of each key: a batch of changed legs reads the index entries of its keys
and then only the dates on which they were or will be; these are rewritten as
their rows without the changed and withdrawn keys, plus the new rows.

The index may name a date too many, which costs a reading, never one too few.
New dates are therefore added to it before any leg is written, and old ones
removed last, so a merge that breaks off can simply be run again, and giving
the same batch twice changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanelytics.operators.layout import with_curve

DATE = "delivery_date"
#: Folders of the index; a small batch reads few of them.
BUCKETS = 64


def with_date(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn(DATE, F.to_date("delivery_ts"))


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    system, folder = _file_system(spark, path)
    return system.exists(folder)


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by date, with the date as such even if no partition has one."""
    return spark.read.parquet(path).withColumn(DATE, F.col(DATE).cast("date"))


def write_dates(rows: DataFrame, path: str, cluster: Sequence[str] = ()) -> None:
    """Rows by date in place of those stored under the same dates; other dates stay as they are.

    With columns to ``cluster`` by, the rows of a date lie on a curve through these columns, dealt to files by range.
    """
    if cluster:
        rows = with_curve(rows, cluster)
        dealt = rows.repartitionByRange(DATE, "_curve").sortWithinPartitions(DATE, "_curve").drop("_curve")
    else:
        dealt = rows.hint("rebalance", DATE)
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE)
        .parquet(path)
    )


def drop_dates(spark: SparkSession, path: str, dates: list[dt.date | None]) -> None:
    """Remove dates that no row is left on, which a write by date cannot."""
    for date in dates:
        name = "__HIVE_DEFAULT_PARTITION__" if date is None else date.isoformat()
        system, folder = _file_system(spark, f"{path}/{DATE}={name}")
        system.delete(folder, True)


def on_dates(dates: list[dt.date | None]) -> Column:
    """Rows of some dates, as a filter on the partition column."""
    known = [F.col(DATE).isin([date for date in dates if date is not None])]
    return reduce(Column.__or__, known + [F.col(DATE).isNull()] * (None in dates))


def _index(path: str) -> str:
    return f"{path.rstrip('/')}.keys"


def _entries(legs: DataFrame, key: str) -> DataFrame:
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    return legs.select(F.col(key).alias("key"), DATE).distinct().withColumn("bucket", bucket)


def _add(entries: DataFrame, path: str) -> None:
    entries.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(_index(path))


def index_keys(spark: SparkSession, path: str, key: str = "warpId") -> None:
    """Build the index of a table anew; reads the key column of all dates, once in a table's life."""
    entries = _entries(read_dates(spark, path), key)
    entries.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_index(path))


def note_keys(legs: DataFrame, path: str, key: str = "warpId") -> None:
    """Add legs that are about to be written to the index, if the table has one."""
    if _exists(legs.sparkSession, _index(path)):
        _add(_entries(legs, key), path)


def merged(old: DataFrame, changed: DataFrame, withdrawn: DataFrame | None = None, key: str = "warpId") -> DataFrame:
    """The old rows without the changed and withdrawn keys, and the changed rows; a key has all rows of its last batch."""
    return old.join(_gone(changed, withdrawn, key), key, "left_anti").unionByName(changed.select(*old.columns))


def _gone(changed: DataFrame, withdrawn: DataFrame | None, key: str) -> DataFrame:
    keys = changed.select(key)
    return (keys if withdrawn is None else keys.unionByName(withdrawn.select(key))).distinct()


def _dates(rows: DataFrame) -> set[dt.date | None]:
    """The dates of some rows: at most as many as the table has partitions, which the driver lists anyway."""
    return {row[0] for row in rows.select(DATE).distinct().collect()}


def merge_enriched(
    changed: DataFrame, path: str, withdrawn: DataFrame | None = None, key: str = "warpId", cluster: Sequence[str] = ()
) -> list[dt.date | None]:
    """Merge enriched legs by key into those stored at a path; the dates that were rewritten or removed.

    Late, corrected and moved legs are given whole in ``changed``, keys of legs that are no more in
    ``withdrawn``.  Keys must not be NULL.  The batch is evaluated several times, so it must not change
    between; legs without a delivery time are stored under the NULL date and merged like others.  ``cluster``
    is as in ``write_enriched``, for the dates that are rewritten.
    """
    spark, changed = changed.sparkSession, with_date(changed)
    gone = _gone(changed, withdrawn, key)
    if not gone.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"legs without {key} cannot be merged by it")
    if not _exists(spark, _index(path)):
        index_keys(spark, path, key)
    _add(_entries(changed, key), path)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    buckets = [row[0] for row in gone.select(bucket).distinct().collect()]
    index = spark.read.parquet(_index(path)).withColumn(DATE, F.col(DATE).cast("date"))
    touched = index.filter(F.col("bucket").isin(buckets))
    keys = gone.withColumnRenamed(key, "key")
    dates = sorted(_dates(touched.join(keys, "key", "left_semi")), key=lambda d: (d is not None, d))
    if not dates:
        return []
    old = read_dates(spark, path).filter(on_dates(dates))
    left = _dates(old.select(key, DATE).join(gone, key, "left_anti")) | _dates(changed)
    write_dates(merged(old, changed, withdrawn, key), path, cluster)
    drop_dates(spark, path, [date for date in dates if date not in left])
    kept = touched.join(keys, "key", "left_anti").select("key", DATE, "bucket").unionByName(_entries(changed, key))
    (
        kept.distinct()
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(_index(path))
    )
    return dates
