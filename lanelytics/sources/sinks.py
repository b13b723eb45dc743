"""Writing results and the reusable enriched leg table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lanelytics.sources.merge import DATE, drop_dates, merge_enriched, note_keys, read_dates, with_date, write_dates

__all__ = ["LANE_AND_CUSTOMER", "merge_enriched", "read_enriched", "refresh_states", "write_csv", "write_enriched", "write_report"]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition of the result."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A statistics frame as Parquet."""
    df.write.mode("overwrite").parquet(path)


#: Columns that single-lane and single-customer reports filter by.
LANE_AND_CUSTOMER = ("startMarket", "endMarket", "clientName")


def write_enriched(enriched: DataFrame, path: str, cluster: Sequence[str] = ()) -> None:
    """Store enriched legs partitioned by delivery date; the dates they hold are replaced as a whole.

    The delivery date is a rule over parsed text, so no filter on it can reach
    a scan of the raw table; stored as a partition column, it can.  The
    rebalance hint lets adaptive execution split a busy date over several tasks
    and merge quiet ones, which a plain repartition by date would not do.

    For batches that hold whole dates.  Late or corrected legs of dates with
    other legs are merged by :func:`merge_enriched`.

    With columns to ``cluster`` by, such as ``LANE_AND_CUSTOMER``, reports on
    one lane or customer skip most row groups and pages of a date; the legs are
    then evaluated once more for each of these columns.
    """
    dated = with_date(enriched)
    note_keys(dated, path)
    write_dates(dated, path, cluster)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Enriched legs written by :func:`write_enriched`."""
    return read_dates(spark, path)


def refresh_states(states: DataFrame, path: str, dates: list[dt.date | None]) -> None:
    """Store the order states of some dates in place of the old ones, as after a merge that changed these."""
    known = [date for date in dates if date is not None]
    present = {row[0] for row in states.select(DATE).distinct().collect()}
    write_dates(states, path)
    drop_dates(states.sparkSession, path, [date for date in known if date not in present])
