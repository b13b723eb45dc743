"""The shared profit rollup.

Every profit report counts distinct orders next to sums.  Asking Spark for
several distinct counts at once copies each input row once per count before
the first shuffle.  Rolling up by key and order first, and by key second, needs
no copies: one pass, partial sums before each exchange, and the first exchange
is spread by order, so a lane that holds a third of all rows is still shared
by every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.money import percent, sum_where

SUMS = (
    "total_revenue",
    "total_cost",
    "crossdock_cost",
    "tonu_revenue",
    "tonu_cost",
    "tonu_rows",
    "leg_rows",
    "main_rows",
    "main_miles",
)


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def leg_sums() -> list[Column]:
    """The sums that every profit measure is made of, over the legs of a group."""
    revenue, cost = F.col("revenueAllocationNumber"), F.col("costAllocationNumber")
    main = F.col("mainShipment") == "YES"
    return [
        F.sum("counted_revenue").alias("total_revenue"),
        F.sum("counted_cost").alias("total_cost"),
        sum_where(F.col("is_crossdock"), cost).alias("crossdock_cost"),
        sum_where(F.col("is_tonu"), revenue).alias("tonu_revenue"),
        sum_where(F.col("is_tonu"), cost).alias("tonu_cost"),
        F.count(F.when(F.col("is_tonu"), 1)).alias("tonu_rows"),
        F.count(F.lit(1)).alias("leg_rows"),
        F.count(F.when(main, 1)).alias("main_rows"),
        F.sum(F.when(main, F.coalesce("shipmentMiles", F.lit(0.0)))).alias("main_miles"),
    ]


def by_order(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key and order, with the order's sums and status flags."""
    return rows.groupBy(*keys, "orderCode").agg(
        _any(F.col("shipmentStatus") == "Complete").alias("has_complete"),
        _any(F.col("shipmentStatus") == "canceled").alias("has_canceled"),
        *leg_sums(),
    )


def profit_rollup(rows: DataFrame, keys: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Profit measures per key: distinct orders, sums and mean main-row miles.

    ``avg_main_miles`` is not rounded; a missing distance on a main row counts
    as zero and keys without main rows have none.  The largest of further
    ``names`` stand for each key: they are grouped with the order first, so
    that a maximum over text, which sorts its rows, only meets orders.
    """
    order = F.col("orderCode")
    largest = [F.max(name).alias(name) for name in names]
    orders = by_order(rows, [*keys, *names])
    if names:
        flags = [F.max(flag).alias(flag) for flag in ("has_complete", "has_canceled")]
        orders = orders.groupBy(*keys, "orderCode").agg(*flags, *[F.sum(name).alias(name) for name in SUMS], *largest)
    summed = orders.groupBy(*keys).agg(
        F.count(F.when(F.col("has_complete"), order)).alias("completed_orders"),
        F.count(F.when(F.col("has_canceled"), order)).alias("canceled_orders"),
        F.count(order).alias("order_count"),
        *[F.sum(name).alias(name) for name in SUMS],
        *largest,
    )
    return with_profit(summed)


def with_profit(summed: DataFrame) -> DataFrame:
    """Profit and the mean distance of main rows, from the sums."""
    return summed.withColumns(
        {
            "total_profit": F.col("total_revenue") - F.col("total_cost"),
            "avg_main_miles": F.when(F.col("main_rows") > 0, F.col("main_miles") / F.col("main_rows")),
        }
    )


def profit_rollup_with_legs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sums of a rollup with distinct orders and distinct legs per key, in one reading.

    Rows shrink to one per key, order and leg first.  Each of these then counts
    once under its order, with its sums, and once under its leg, without.
    """
    parts = rows.groupBy(*keys, "orderCode", "warpId").agg(*leg_sums())
    order = F.struct(F.lit(True).alias("is_order"), F.col("orderCode").alias("id"), *[F.col(name).alias(name) for name in SUMS])
    none = [F.lit(None).cast(parts.schema[name].dataType).alias(name) for name in SUMS]
    leg = F.struct(F.lit(False).alias("is_order"), F.col("warpId").alias("id"), *none)
    twice = parts.select(*keys, F.explode(F.array(order, leg)).alias("as")).select(*keys, "as.*")
    by_id = twice.groupBy(*keys, "is_order", "id").agg(*[F.sum(name).alias(name) for name in SUMS])
    return with_profit(
        by_id.groupBy(*keys).agg(
            F.count(F.when(F.col("is_order"), F.col("id"))).alias("order_count"),
            F.count(F.when(~F.col("is_order"), F.col("id"))).alias("shipment_count"),
            *[F.sum(name).alias(name) for name in SUMS],
        )
    )


def with_rates(summed: DataFrame) -> DataFrame:
    """Margin and cross-dock share in percent, 0 where there is nothing to divide by."""
    return summed.withColumns(
        {
            "margin_pct": percent(F.col("total_profit"), F.col("total_revenue")),
            "xd_cost_pct": percent(F.col("crossdock_cost"), F.col("total_cost")),
            "avg_miles": F.round("avg_main_miles", 0),
        }
    )


def distinct_count(rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct non-null values per key, as two plain groupings.

    The first is spread by key and value, so no task holds all values of a key.
    """
    return rows.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias(name))
