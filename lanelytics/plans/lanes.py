"""Profit by lane, market and zip pair, and comparisons between lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.labels import comparison_tag, lane_label, zip_lane_display
from lanelytics.functions.money import percent
from lanelytics.operators.order_states import states_rollup
from lanelytics.operators.predicates import (
    MARKETS,
    ZIPS,
    keys_present,
    population,
    same_market,
    standard_population,
)
from lanelytics.operators.ranks import sort_columns
from lanelytics.operators.rollup import distinct_count, profit_rollup, with_rates
from lanelytics.query import LegQuery

LANE_COLUMNS = (
    "lane", "startMarket", "endMarket", "completed_orders", "canceled_orders", "avg_miles",
    "total_revenue", "total_cost", "crossdock_cost", "total_profit", "margin_pct", "xd_cost_pct",
    "tonu_revenue", "tonu_cost",
)


#: Orders of the lane, peer and tagged peer reports.
BEST_FIRST, WORST_PEER_FIRST = ("-total_profit", "lane"), ("profit", "lane")
SELECTED_FIRST = ("comparison_type", *WORST_PEER_FIRST)  # "Selected" sorts before "Similar Mileage"


def lane_profit(enriched: DataFrame, query: LegQuery) -> DataFrame:
    """Profit by market lane, best first; each leg counts towards its own lane.

    Percentages are rounded to one decimal, halves to even.
    """
    return lane_report(profit_rollup(population(enriched, query), MARKETS))


def lane_profit_of_range(states: DataFrame, query: LegQuery) -> DataFrame:
    """Profit by market lane from stored order states, without reading legs."""
    return lane_report(states_rollup(states, query))


def lane_report(rollup: DataFrame) -> DataFrame:
    """The lane report of a rollup by lane: lanes with an order or a truck ordered but not used."""
    lanes = rollup.filter(
        (F.col("completed_orders") > 0) | (F.col("canceled_orders") > 0) | (F.col("tonu_rows") > 0)
    )
    return with_rates(lanes).select(
        lane_label(*MARKETS).alias("lane"),
        *MARKETS,
        "completed_orders",
        "canceled_orders",
        (F.col("completed_orders") + F.col("canceled_orders")).alias("total_orders"),
        "total_revenue",
        "total_cost",
        "total_profit",
        "crossdock_cost",
        F.bround("xd_cost_pct", 1).alias("crossdock_cost_pct"),
        F.bround("margin_pct", 1).alias("margin_pct"),
        "tonu_revenue",
        "tonu_cost",
    ).orderBy(*sort_columns(BEST_FIRST))


def lane_allocation(enriched: DataFrame, known_only: bool = True) -> DataFrame:
    """Row-level profit by lane over all dates.

    Lanes with an unknown end are left out, or else shown under ``NA``.
    """
    rows = enriched.filter(standard_population())
    rows = rows.filter(keys_present(*MARKETS)) if known_only else rows
    named = rows.withColumns({m: F.coalesce(F.col(m), F.lit("NA")) for m in MARKETS})
    return (
        profit_rollup(named, MARKETS)
        .select(
            *MARKETS,
            lane_label(*MARKETS).alias("lane"),
            F.col("total_revenue").alias("lane_revenue"),
            F.col("total_cost").alias("lane_cost"),
            F.col("total_profit").alias("lane_profit"),
        )
        .orderBy(F.desc("lane_profit"), "lane")
    )


def market_profit(enriched: DataFrame, query: LegQuery) -> DataFrame:
    """Profit of legs that stay within one market, worst first."""
    rows = population(enriched, query, keys=("startMarket",)).filter(same_market())
    return market_report(profit_rollup(rows, ["startMarket"]))


def market_profit_of_range(states: DataFrame, query: LegQuery) -> DataFrame:
    """Profit within markets from stored order states, without reading legs."""
    return market_report(states_rollup(states.filter(same_market()), query, ["startMarket"]))


def market_report(rollup: DataFrame) -> DataFrame:
    """The market report of a rollup by market."""
    return (
        with_rates(rollup)
        .select(
            F.col("startMarket").alias("market"),
            "completed_orders", "canceled_orders", "total_revenue", "total_cost", "total_profit",
            "crossdock_cost", "margin_pct", "tonu_revenue", "tonu_cost",
        )
        .orderBy(F.col("total_profit"), "market")
    )


def _having(lanes: DataFrame, min_orders: int, only_negative: bool) -> DataFrame:
    kept = lanes.filter(F.col("order_count") >= min_orders)
    return kept.filter(F.col("total_profit") < 0) if only_negative else kept


def lane_diagnostics(
    enriched: DataFrame, query: LegQuery, min_orders: int = 5, only_negative: bool = True
) -> DataFrame:
    """Lanes with enough orders, worst first, with mileage and rates."""
    lanes = _having(profit_rollup(population(enriched, query), MARKETS), min_orders, only_negative)
    return (
        with_rates(lanes)
        .withColumn("lane", lane_label(*MARKETS))
        .select(*LANE_COLUMNS)
        .orderBy(F.col("total_profit"), "lane")
    )


def zip_diagnostics(
    enriched: DataFrame, query: LegQuery, min_orders: int = 5, only_negative: bool = True
) -> DataFrame:
    """Zip pairs with enough orders, worst first, with representative places.

    The largest city and market names stand for the pair.
    """
    places = ("pickCity", "dropCity", *MARKETS)
    rollup = profit_rollup(population(enriched, query, keys=ZIPS), ZIPS, places)
    lanes = _having(rollup, min_orders, only_negative)
    return (
        with_rates(lanes)
        .withColumn("lane", lane_label(*ZIPS))
        .withColumn("lane_display", zip_lane_display())
        .select("lane", "lane_display", *ZIPS, "pickCity", "dropCity", *LANE_COLUMNS[1:])
        .orderBy(F.col("total_profit"), "lane")
    )


def similar_mileage(
    enriched: DataFrame,
    query: LegQuery,
    target_miles: float | Column,
    tolerance: float = 0.2,
    min_orders: int = 3,
) -> DataFrame:
    """Lanes whose mean main-row distance is within a tolerance of the target.

    The target is normally the rounded mean of the selected lane; the unrounded
    mean of each lane is compared with it.  ``target_miles`` may be a scalar
    subquery, so that it is found within the same plan.  Without a known target
    distance there are no peers.  Legs are counted on the lanes that are left
    only, whose measures go along as grouping keys.
    """
    target = target_miles if isinstance(target_miles, Column) else F.lit(float(target_miles))
    rows = population(enriched, query)
    lanes = profit_rollup(rows, MARKETS).filter(
        (target > 0)
        & (F.col("avg_main_miles") >= target * (1 - tolerance))
        & (F.col("avg_main_miles") <= target * (1 + tolerance))
        & (F.col("order_count") >= min_orders)
    )
    report = with_rates(lanes).drop(*MARKETS).columns
    legs = rows.select(*MARKETS, "warpId").join(with_rates(lanes), list(MARKETS))
    counted = distinct_count(legs, [*MARKETS, *report], "warpId", "shipment_count")
    return (
        counted.select(
            lane_label(*MARKETS).alias("lane"),
            *MARKETS, "completed_orders", "canceled_orders", "avg_miles",
            "total_revenue", "total_cost", "crossdock_cost", F.col("total_profit").alias("profit"),
            "margin_pct", "xd_cost_pct",
            (F.col("shipment_count") / F.col("order_count")).alias("avg_legs"),
            "tonu_revenue", "tonu_cost",
        )
        .orderBy(*sort_columns(WORST_PEER_FIRST))
    )


def tagged_peers(peers: DataFrame, selected: str) -> DataFrame:
    """Similar lanes with the selected one marked and first, then worst first."""
    tagged = peers.withColumn("comparison_type", comparison_tag(F.col("lane"), selected))
    return tagged.orderBy(*sort_columns(SELECTED_FIRST))


def peer_comparison(peers: DataFrame, selected: str) -> DataFrame:
    """The selected lane's profit against the mean of its peers.

    No row if the lane or its peers are missing.
    """
    is_selected = F.col("lane") == selected
    summed = peers.agg(
        F.max(F.when(is_selected, F.col("profit"))).cast("double").alias("selected_profit"),
        F.count(F.when(~is_selected, 1)).alias("peer_lanes"),
        F.sum(F.when(~is_selected, F.col("profit"))).cast("double").alias("peer_sum"),
    ).filter(F.col("selected_profit").isNotNull() & (F.col("peer_lanes") > 0))
    mean = F.col("peer_sum") / F.col("peer_lanes")
    difference = F.col("selected_profit") - F.col("peer_avg_profit")
    return (
        summed.withColumn("peer_avg_profit", mean)
        .withColumn("difference", difference)
        .withColumn(
            "difference_pct",
            F.when(F.col("peer_avg_profit") != 0, F.col("difference") / F.abs("peer_avg_profit") * 100).otherwise(0.0),
        )
        .select("selected_profit", "peer_lanes", "peer_avg_profit", "difference", "difference_pct")
    )


def target_miles(lanes: DataFrame, selected: str) -> Column:
    """The rounded mean distance of one lane, as a scalar subquery."""
    return lanes.filter(F.col("lane") == selected).select("avg_miles").scalar()


def headline(lanes: DataFrame) -> DataFrame:
    """Totals over a lane or market result.

    Orders are added up over lanes, so an order on two lanes counts twice.
    """
    loss = F.col("total_profit") < 0
    names = ("total_revenue", "total_cost", "total_profit", "crossdock_cost", "tonu_revenue", "tonu_cost")
    summed = lanes.agg(
        F.count(F.lit(1)).alias("lanes_shown"),
        F.count(F.when(loss, 1)).alias("negative_lanes"),
        F.coalesce(F.sum(F.when(loss, F.col("total_profit"))), F.lit(0).cast("decimal(18,4)")).alias("total_loss"),
        F.sum("completed_orders").alias("completed_orders"),
        F.sum("canceled_orders").alias("canceled_orders"),
        F.coalesce(F.sum(F.when(loss, F.col("completed_orders"))), F.lit(0)).alias("completed_affected"),
        F.coalesce(F.sum(F.when(loss, F.col("canceled_orders"))), F.lit(0)).alias("canceled_affected"),
        *[F.sum(n).alias(n) for n in names],
    )
    return summed.withColumns(
        {
            "crossdock_cost_pct": percent(F.col("crossdock_cost"), F.col("total_cost")),
            "tonu_cost_pct": percent(F.col("tonu_cost"), F.col("total_cost")),
            "tonu_profit": F.col("tonu_revenue") - F.col("tonu_cost"),
        }
    )


def lanes_named_na(lanes: DataFrame) -> DataFrame:
    """How many lane labels contain ``NA``."""
    return lanes.filter(F.col("lane").contains("NA")).agg(F.count(F.lit(1)).alias("na_lanes"))
