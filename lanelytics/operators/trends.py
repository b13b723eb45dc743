"""Change and smoothing over periods.

Periods without rows are filled in first, so that the period before is the one
before by the calendar.  All work on one row per key and period, so that their windows hold as many
rows as there are periods, however many legs a period has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _timeline(keys: Sequence[str], period: str):
    return Window.partitionBy(*keys if keys else [F.lit(0)]).orderBy(period)


def by_period(rows: DataFrame, period: Column, amount: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Legs and the sum of an amount per key and period."""
    return (
        rows.withColumn("period", period)
        .filter(F.col("period").isNotNull())
        .groupBy(*keys, "period")
        .agg(F.count(F.lit(1)).alias("legs"), F.sum(amount).alias("amount"))
    )


def with_every_period(periods: DataFrame, step: str, keys: Sequence[str] = ()) -> DataFrame:
    """The periods with those between that have no rows: from the first to the last of each key, with zero sums.

    ``step`` is an interval such as ``7 DAYS`` or ``1 MONTH``.
    """
    spans = periods.groupBy(*keys).agg(F.min("period").alias("first"), F.max("period").alias("last"))
    filled = spans.filter(F.col("first").isNotNull()).select(
        *keys, F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {step}"))).alias("period")
    )
    known = periods.withColumnsRenamed({name: f"_known_{name}" for name in (*keys, "period")})
    same = [F.col(name).eqNullSafe(F.col(f"_known_{name}")) for name in (*keys, "period")]
    zero = F.lit(0).cast(periods.schema["amount"].dataType)
    return filled.join(known, reduce(Column.__and__, same), "left").select(
        *keys, "period", F.coalesce("legs", F.lit(0)).alias("legs"), F.coalesce("amount", zero).alias("amount")
    )


def with_change(periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The change against the row of the previous period, also in percent."""
    previous = F.lag("amount").over(_timeline(keys, "period"))
    change = F.col("amount") - F.col("previous")
    return (
        periods.withColumn("previous", previous)
        .withColumn("change", change)
        .withColumn(
            "change_pct",
            F.when(
                F.col("previous") != 0,
                F.col("change").cast("double") * 100 / F.abs("previous").cast("double"),
            ),
        )
    )


def with_rolling_average(periods: DataFrame, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """The mean over the rows of the last ``width`` periods, this one included."""
    frame = _timeline(keys, "period").rowsBetween(1 - width, 0)
    mean = F.sum("amount").over(frame).cast("double") / F.count("amount").over(frame)
    return periods.withColumn("rolling_avg", mean)
