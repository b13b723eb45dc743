"""Distribution statistics and trends of profit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.times import month_of, week_of
from lanelytics.operators.quantile import exact_percentiles
from lanelytics.operators.trends import by_period, with_change, with_every_period, with_rolling_average
from lanelytics.plans.profit_reports import leg_margins


def _named(rows: DataFrame, statistics: dict[str, Column]) -> DataFrame:
    """One row per named statistic."""
    summed = rows.agg(*[column.cast("double").alias(name) for name, column in statistics.items()])
    pairs = [F.struct(F.lit(name).alias("statistic"), F.col(name).alias("value")) for name in statistics]
    return summed.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def _percentiles(rows: DataFrame, value: str, names: dict[str, float]) -> DataFrame:
    label = reduce(
        lambda chain, item: chain.when(F.col("probability") == item[1], F.lit(item[0])),
        names.items(),
        F.when(F.lit(False), F.lit("")),
    )
    return exact_percentiles(rows, value, list(names.values())).select(label.alias("statistic"), "value")


def margin_summary(rows: DataFrame) -> DataFrame:
    """Mean, median, 90th percentile and sample deviation of leg margins."""
    margins = leg_margins(rows).select("margin")
    plain = _named(margins, {"mean": F.avg("margin"), "std": F.stddev_samp("margin")})
    return plain.unionByName(_percentiles(margins, "margin", {"median": 0.5, "p90": 0.9}))


def margin_distribution(rows: DataFrame) -> DataFrame:
    """Revenue-weighted mean, variance and outer percentiles of leg margins,
    and the correlation of revenue with cost."""
    legs = leg_margins(rows).filter(F.col("margin").isNotNull())
    revenue, cost = F.col("revenueAllocationNumber"), F.col("costAllocationNumber")
    plain = _named(
        legs,
        {
            "weighted_mean": F.sum("profit").cast("double") / F.sum(revenue).cast("double"),
            "variance": F.var_samp("margin"),
            "revenue_cost_correlation": F.corr(revenue.cast("double"), cost.cast("double")),
        },
    )
    return plain.unionByName(_percentiles(legs, "margin", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


def _profit(enriched: DataFrame, period: Column, step: str | None, keys: tuple[str, ...]) -> DataFrame:
    periods = by_period(enriched, period, F.col("counted_revenue") - F.col("counted_cost"), keys)
    return periods if step is None else with_every_period(periods, step, keys)


def weekly_change(enriched: DataFrame, keys: tuple[str, ...] = (), every_period: bool = True) -> DataFrame:
    """Counted profit per delivery week, with its week-over-week change.

    A week without legs counts with a profit of zero; without ``every_period``
    it is left out, and a change is against the last week that has legs.
    """
    periods = _profit(enriched, week_of(F.col("delivery_ts")), "7 DAYS" if every_period else None, keys)
    return with_change(periods, keys)


def monthly_change(enriched: DataFrame, keys: tuple[str, ...] = (), every_period: bool = True) -> DataFrame:
    """Counted profit per delivery month, with its month-over-month change; empty months as in ``weekly_change``."""
    periods = _profit(enriched, month_of(F.col("delivery_ts")), "1 MONTH" if every_period else None, keys)
    return with_change(periods, keys)


def rolling_profit(
    enriched: DataFrame, width: int = 4, keys: tuple[str, ...] = ("lane",), every_period: bool = True
) -> DataFrame:
    """Counted profit per lane and delivery month, with its rolling mean; empty months as in ``weekly_change``."""
    periods = _profit(enriched, month_of(F.col("delivery_ts")), "1 MONTH" if every_period else None, keys)
    return with_rolling_average(periods, width, keys)
