"""Legs put together with routes, carriers, clients, quotes and shipments.

Join strategies are left to Catalyst, which broadcasts a side only if its size
is known to be small.  Where both sides may hold many rows per key, each is
brought to one row per key first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanelytics.functions.labels import shipment_code, shipment_number
from lanelytics.functions.money import or_zero
from lanelytics.operators.predicates import customer_view
from lanelytics.sources.tables import explode_codes


def orders_with_main_legs(headers: DataFrame, legs: DataFrame) -> DataFrame:
    """Order headers with their main rows; one row per main row."""
    main = legs.filter(customer_view())
    return headers.join(main, headers["code"] == main["orderCode"]).select(
        "code",
        "customerName",
        "status",
        F.col("warpId"),
        F.col("startMarket"),
        F.col("endMarket"),
        F.col("loadId"),
    )


def legs_with_routes(legs: DataFrame, routes: DataFrame) -> DataFrame:
    """Legs with their load's route carrier; legs without a route are kept.

    Both sides come to the join straight from a shuffle, so adaptive execution
    can split a load that carries very many legs.
    """
    route = routes.select(F.col("routeId").alias("loadId"), F.col("carrierName").alias("route_carrier"))
    return legs.join(route, "loadId", "left")


def route_agreement(legs: DataFrame, routes: DataFrame) -> DataFrame:
    """Legs whose carrier is, is not, or lacks the carrier of their route.

    Legs are counted per load and carrier before they meet the routes.
    """
    grouped = legs.groupBy("loadId", "carrierName").agg(F.count(F.lit(1)).alias("legs"))
    route = routes.select(F.col("routeId").alias("loadId"), F.col("carrierName").alias("route_carrier"))
    same = F.col("carrierName") == F.col("route_carrier")
    match = F.when(same, F.lit("same")).when(~same, F.lit("different")).otherwise(F.lit("unknown"))
    return grouped.join(route, "loadId", "left").groupBy(match.alias("agreement")).agg(F.sum("legs").alias("legs"))


def _per_name(legs: DataFrame, column: str) -> DataFrame:
    return legs.groupBy(column).agg(
        F.count(F.lit(1)).alias("legs"),
        F.sum(or_zero(F.col("revenueAllocationNumber"))).alias("revenue"),
        F.sum(or_zero(F.col("costAllocationNumber"))).alias("cost"),
    )


def carrier_directory(legs: DataFrame, carriers: DataFrame) -> DataFrame:
    """Legs and amounts per known carrier, matched by name and not by id."""
    named = _per_name(legs, "carrierName")
    return named.join(carriers, named["carrierName"] == carriers["name"]).select("id", "name", "legs", "revenue", "cost")


def client_directory(legs: DataFrame, clients: DataFrame) -> DataFrame:
    """Legs and amounts per known client, matched by name and not by id."""
    named = _per_name(legs, "clientName")
    return named.join(clients, named["clientName"] == clients["name"]).select("id", "name", "legs", "revenue", "cost")


def client_quotes(legs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes next to legs per customer text."""
    named = _per_name(legs, "clientName")
    quoted = quotes.groupBy("customer").agg(F.count(F.lit(1)).alias("quotes"), F.sum("price").alias("quoted"))
    return named.join(quoted, named["clientName"] == quoted["customer"]).select(
        "customer", "quotes", "quoted", "legs", "revenue"
    )


def handling_by_site(legs: DataFrame, records: DataFrame) -> DataFrame:
    """Handling records with the amounts of the legs they name, per cross-dock."""
    named = records.join(legs, records["shipmentId"] == legs["warpId"])
    return named.groupBy("crossdock").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(or_zero(F.col("revenueAllocationNumber"))).alias("revenue"),
        F.sum(or_zero(F.col("costAllocationNumber"))).alias("cost"),
    )


def legs_on_routes(legs: DataFrame, routes: DataFrame) -> DataFrame:
    """The legs that routes list in their JSON code arrays."""
    listed = explode_codes(routes.select("routeId", "shipmentCodes"), "shipmentCodes", "warpId")
    return listed.join(legs, "warpId").select("routeId", "warpId", "orderCode", "loadId")


def shipment_links(legs: DataFrame, shipments: DataFrame) -> DataFrame:
    """Shipments named by legs, with the shipment they hang off.

    Legs write ``S-123`` where shipments write ``123``; the parent link goes
    one step up and is again written ``S-123``.
    """
    per_shipment = legs.groupBy(shipment_number(F.col("shipmentWarpId")).alias("number")).agg(
        F.count(F.lit(1)).alias("legs")
    )
    child = shipments.select(
        shipment_number(F.col("warpId")).alias("number"),
        shipment_number(F.col("parent")).alias("parent_number"),
        "code",
    )
    parent = shipments.select(
        shipment_number(F.col("warpId")).alias("parent_number"), F.col("code").alias("parent_code")
    )
    return (
        per_shipment.join(child, "number")
        .join(parent, "parent_number", "left")
        .select(shipment_code(F.col("number")).alias("shipmentWarpId"), "code", "parent_code", "legs")
    )
