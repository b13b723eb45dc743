"""Drill-down into one customer or lane, and the lists to choose from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanelytics.functions.labels import lane_label, split_lane, yes_no
from lanelytics.functions.money import or_zero, percent, profit, sum_where
from lanelytics.operators.predicates import (
    MARKETS,
    detail_rows,
    equals,
    keys_present,
    matching,
    not_removed,
    population,
)
from lanelytics.operators.rollup import profit_rollup
from lanelytics.operators.ranks import sort_columns
from lanelytics.query import LegQuery


def drill_headline(
    enriched: DataFrame, query: LegQuery, customer: str | None = None, lane: str | None = None
) -> DataFrame:
    """Totals of the standard population for a customer, a lane or both.

    Lane text that is not two markets joined by the arrow filters nothing.
    """
    rows = population(enriched, query, keys=())
    if customer is not None:
        rows = rows.filter(F.col("clientName") == customer)
    ends = split_lane(lane)
    if ends:
        rows = rows.filter(equals(dict(zip(MARKETS, ends))))
    return (
        profit_rollup(rows)
        .withColumns(
            {
                "crossdock_cost_pct": percent(F.col("crossdock_cost"), F.col("total_cost")),
                "tonu_cost_pct": percent(F.col("tonu_cost"), F.col("total_cost")),
            }
        )
        .select(
            "completed_orders", "canceled_orders", "total_revenue", "total_cost", "crossdock_cost",
            "tonu_revenue", "tonu_cost", "total_profit", "crossdock_cost_pct", "tonu_cost_pct",
        )
    )


#: The order of listed legs, by the names that they are listed under.
DETAIL_ORDER = ("Order ID", "-Main Shipment", "Warp ID")


def drill_detail(
    enriched: DataFrame,
    query: LegQuery,
    customer: str | None = None,
    lane: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Single legs with their full amounts, whatever their status but removed.

    Unlike the headline it lists uncounted legs too, and of parcel orders the
    main rows only.  Without a ``limit`` everything is listed, as an export needs.
    """
    rows = matching(enriched, query).filter(not_removed() & detail_rows(query.shipment_type))
    if customer is not None:
        rows = rows.filter(F.col("clientName") == customer)
    if lane is not None:
        rows = rows.filter(F.col("lane") == lane)
    revenue, cost = F.col("revenueAllocationNumber"), F.col("costAllocationNumber")
    detail = rows.orderBy(*sort_columns(("orderCode", "-mainShipment", "warpId"))).select(
        F.col("orderCode").alias("Order ID"),
        F.col("warpId").alias("Warp ID"),
        F.col("mainShipment").alias("Main Shipment"),
        F.col("lane").alias("Lane"),
        F.col("clientName").alias("Customer"),
        F.col("carrierName").alias("Carrier"),
        F.col("pickLocationName").alias("Pickup Location"),
        F.col("dropLocationName").alias("Drop Location"),
        or_zero(revenue).alias("Revenue"),
        or_zero(cost).alias("Cost"),
        profit(revenue, cost).alias("Profit"),
        yes_no(F.col("is_crossdock")).alias("Cross-dock"),
        F.col("shipmentType").alias("Shipment Type"),
        F.col("pickWindowFrom").alias("Pickup Window"),
    )
    return detail if limit is None else detail.limit(limit)


def detail_totals(detail: DataFrame) -> DataFrame:
    """Totals over listed legs, for when there is no headline."""
    cost = F.col("Cost")
    return (
        detail.groupBy("Order ID")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("Revenue").alias("revenue"),
            F.sum(cost).alias("cost"),
            F.sum("Profit").alias("profit"),
            sum_where(F.col("Cross-dock") == "Yes", cost).alias("crossdock_cost"),
        )
        .agg(
            F.count("Order ID").alias("completed_orders"),
            F.sum("rows").alias("total_rows"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("cost").alias("total_cost"),
            F.sum("profit").alias("total_profit"),
            F.sum("crossdock_cost").alias("crossdock_cost"),
        )
    )


def customer_list(legs: DataFrame, limit: int | None = None) -> DataFrame:
    """The first customer names in order."""
    names = legs.filter(keys_present("clientName")).select("clientName").distinct()
    listed = names.orderBy("clientName")
    return listed if limit is None else listed.limit(limit)


def lane_list(legs: DataFrame, customer: str | None = None, limit: int | None = None) -> DataFrame:
    """The first lane labels in order, of one customer or of all."""
    rows = legs.filter(keys_present(*MARKETS))
    if customer is not None:
        rows = rows.filter(F.col("clientName") == customer)
    listed = rows.select(lane_label(*MARKETS).alias("lane")).distinct().orderBy("lane")
    return listed if limit is None else listed.limit(limit)
