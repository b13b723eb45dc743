"""Who is behind one lane: customers, carriers and the legs themselves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.labels import yes_no
from lanelytics.functions.money import percent, ratio
from lanelytics.operators.predicates import ZIPS, equals, keys_present, population
from lanelytics.operators.rollup import profit_rollup, profit_rollup_with_legs
from lanelytics.query import LegQuery


def market_lane(start: str, end: str) -> dict[str, str]:
    return {"startMarket": start, "endMarket": end}


def zip_lane(pick: str, drop: str) -> dict[str, str]:
    return {"pickZipCode": pick, "dropZipCode": drop}


def _rows(enriched: DataFrame, query: LegQuery, lane: Mapping[str, str]) -> DataFrame:
    return population(enriched, query, keys=tuple(lane)).filter(equals(lane))


def lane_customers(enriched: DataFrame, query: LegQuery, lane: Mapping[str, str]) -> DataFrame:
    """Profit by customer on one lane, worst first."""
    orders = F.col("completed_orders") + F.col("canceled_orders")
    return (
        profit_rollup(_rows(enriched, query, lane), ["clientName"])
        .select(
            F.col("clientName").alias("customer"),
            "completed_orders", "canceled_orders", "total_revenue", "total_cost", "total_profit",
            percent(F.col("total_profit"), F.col("total_revenue")).alias("margin_pct"),
            ratio(F.col("total_profit"), orders).alias("avg_profit_per_order"),
            "tonu_revenue", "tonu_cost",
        )
        .orderBy(F.col("total_profit"), "customer")
    )


def lane_carriers(enriched: DataFrame, query: LegQuery, lane: Mapping[str, str]) -> DataFrame:
    """Profit by named carrier on one lane, worst first."""
    rows = _rows(enriched, query, lane).filter(keys_present("carrierName"))
    return (
        profit_rollup_with_legs(rows, ["carrierName"])
        .select(
            F.col("carrierName").alias("carrier"),
            F.col("order_count").alias("orders_with_carrier"),
            "shipment_count", "total_cost", "total_revenue", "total_profit",
            ratio(F.col("total_profit"), F.col("shipment_count")).alias("avg_profit_per_shipment"),
        )
        .orderBy(F.col("total_profit"), "carrier")
    )


def carrier_extremes(carriers: DataFrame) -> DataFrame:
    """The most used carrier and the worst by total and by mean profit.

    Ties go to the carrier that the breakdown lists first.
    """

    def first_by(*order: Column) -> Column:
        return F.min_by("carrier", F.struct(*order, "total_profit", "carrier"))

    return carriers.agg(
        F.count(F.lit(1)).alias("total_carriers"),
        first_by((-F.col("orders_with_carrier")).alias("k")).alias("most_used"),
        F.max("orders_with_carrier").alias("most_used_orders"),
        first_by().alias("worst_profit_carrier"),
        F.min("total_profit").alias("worst_profit"),
        first_by(F.col("avg_profit_per_shipment").alias("k")).alias("worst_avg_carrier"),
        F.min("avg_profit_per_shipment").alias("worst_avg_profit"),
    )


def order_details(enriched: DataFrame, query: LegQuery, lane: Mapping[str, str]) -> DataFrame:
    """Every counted leg of one lane, for export; zip lanes also list their places."""
    places = ("pickZipCode", "dropZipCode", "pickCity", "dropCity") if tuple(lane) == ZIPS else ()
    return (
        _rows(enriched, query, lane)
        .select(
            "orderCode",
            "warpId",
            F.col("clientName").alias("customer"),
            "shipmentStatus", "mainShipment", "pickLocationName", "dropLocationName",
            *places,
            "startMarket", "endMarket",
            F.col("dropWindowFrom").alias("scheduled_delivery"),
            F.coalesce("dropTimeArrived", "dropDateArrived").alias("actual_delivery"),
            F.col("carrierName").alias("carrier"),
            "accessorialType",
            F.col("counted_revenue").alias("revenue"),
            F.col("counted_cost").alias("cost"),
            yes_no(F.col("is_tonu")).alias("is_tonu"),
            yes_no(F.col("is_crossdock")).alias("is_crossdock"),
        )
        .orderBy("orderCode", F.desc("mainShipment"), "warpId")
    )
