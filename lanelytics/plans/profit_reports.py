"""Periodic profit of customers and lanes, from order headers or from legs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.labels import lane_label
from lanelytics.functions.money import header_amount, percent_or_null
from lanelytics.functions.times import in_previous_month, iso_date
from lanelytics.operators.predicates import MARKETS, customer_view, keys_present


def _revenue() -> Column:
    return F.col("revenueAllocationNumber")


def _cost() -> Column:
    return F.col("costAllocationNumber")


def _sums(revenue: Column, cost: Column) -> list[Column]:
    """Sums over one order; profit takes rows with both amounts only."""
    return [
        F.sum(revenue).alias("total_revenue"),
        F.sum(cost).alias("total_cost"),
        F.sum(revenue - cost).alias("total_profit"),
    ]


def _total(per_order: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add up per-order sums; orders are counted after each became one row."""
    return per_order.groupBy(*keys).agg(
        F.count(order).alias("order_count"),
        *[F.sum(n).alias(n) for n in ("total_revenue", "total_cost", "total_profit")],
    )


def _margin(df: DataFrame) -> DataFrame:
    return df.withColumn("margin_pct", F.round(percent_or_null(F.col("total_profit"), F.col("total_revenue")), 1))


def customer_profit_from_headers(
    headers: DataFrame, customer: str | None = None, as_of: dt.date | None = None
) -> DataFrame:
    """Completed orders' profit by type from order headers, by creation month."""
    rows = headers.filter(F.col("status") == "Complete")
    if customer is not None:
        rows = rows.filter(F.col("customerName") == customer)
    if as_of is not None:
        rows = rows.filter(in_previous_month(iso_date(F.col("createdAt")).cast("timestamp_ntz"), as_of))
    revenue, cost = header_amount(F.col("revenueAllocation")), header_amount(F.col("costAllocation"))
    per_order = rows.groupBy("shipmentType", "code").agg(*_sums(revenue, cost))
    return _total(per_order, ["shipmentType"], "code")


def _main_rows(enriched: DataFrame, as_of: dt.date | None) -> DataFrame:
    rows = enriched.filter(customer_view() & (F.col("shipmentStatus") == "Complete"))
    return rows.filter(in_previous_month(F.col("drop_from_ts"), as_of)) if as_of is not None else rows


def customer_profit_from_legs(
    enriched: DataFrame, customer: str | None = None, as_of: dt.date | None = None
) -> DataFrame:
    """Completed main rows' profit by type, by scheduled delivery month."""
    rows = _main_rows(enriched, as_of)
    if customer is not None:
        rows = rows.filter(F.col("clientName") == customer)
    per_order = rows.groupBy("shipmentType", "orderCode").agg(*_sums(_revenue(), _cost()))
    return _margin(_total(per_order, ["shipmentType"], "orderCode"))


def lane_profit_from_legs(enriched: DataFrame, as_of: dt.date | None = None, limit: int | None = None) -> DataFrame:
    """The most profitable lanes by type, over completed main rows."""
    rows = _main_rows(enriched, as_of).filter(keys_present(*MARKETS))
    per_order = rows.groupBy(*MARKETS, "shipmentType", "orderCode").agg(*_sums(_revenue(), _cost()))
    lanes = _margin(_total(per_order, [*MARKETS, "shipmentType"], "orderCode"))
    return _best(lanes, limit)


def lane_profit_from_headers(
    enriched: DataFrame,
    headers: DataFrame,
    as_of: dt.date | None = None,
    limit: int | None = None,
    once_per_order: bool = False,
) -> DataFrame:
    """The most profitable lanes by type, with header amounts on main-row lanes.

    A multidrop order has several main rows and its header amount counts once
    for each; ``once_per_order`` counts it once per lane.
    """
    main = enriched.filter(customer_view() & keys_present(*MARKETS))
    main = main.filter(in_previous_month(F.col("drop_from_ts"), as_of)) if as_of is not None else main
    # One row per order and lane before the join: the copies travel as a number.
    main = main.groupBy("orderCode", *MARKETS).agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("copies"))
    copies = F.lit(1).cast("decimal(18,0)") if once_per_order else F.col("copies")
    revenue, cost = header_amount(F.col("revenueAllocation")), header_amount(F.col("costAllocation"))
    orders = headers.filter(F.col("status") == "Complete").select(
        "code", "shipmentType", revenue.alias("revenue"), cost.alias("cost")
    )
    per_order = (
        orders.join(main, orders["code"] == main["orderCode"])
        .groupBy(*MARKETS, "shipmentType", "code")
        .agg(*_sums(F.col("revenue") * copies, F.col("cost") * copies))
    )
    return _best(_total(per_order, [*MARKETS, "shipmentType"], "code"), limit)


def _best(lanes: DataFrame, limit: int | None) -> DataFrame:
    named = lanes.withColumn("lane", lane_label(*MARKETS))
    best = named.orderBy(F.col("total_profit").desc_nulls_last(), "lane", "shipmentType")
    return best if limit is None else best.limit(limit)


def leg_margins(rows: DataFrame) -> DataFrame:
    """Legs with ``profit`` and ``margin`` of revenue; none without revenue."""
    return rows.withColumns(
        {
            "profit": _revenue() - _cost(),
            "margin": F.when(
                _revenue() != 0, (_revenue() - _cost()).cast("double") / _revenue().cast("double")
            ),
        }
    )
