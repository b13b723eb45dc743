"""Row filters over enriched legs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.times import midnight, present
from lanelytics.query import ALL_TYPES, LegQuery

MARKETS = ("startMarket", "endMarket")
ZIPS = ("pickZipCode", "dropZipCode")


def standard_population() -> Column:
    """Completed or canceled legs, and trucks ordered but not used at any status."""
    return F.col("shipmentStatus").isin("Complete", "canceled") | (F.col("accessorialType") == "TONU")


def not_removed() -> Column:
    """Any status but removed; a missing status is not kept."""
    return F.col("shipmentStatus") != "removed"


def keys_present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [present(F.col(c)) for c in columns])


def equals(values: Mapping[str, str]) -> Column:
    """Every named column has the given value."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()])


def same_market() -> Column:
    return F.col("startMarket") == F.col("endMarket")


def completed_work(side: str) -> Column:
    """Completed legs, and legs whose ``pick`` or ``drop`` succeeded."""
    return (F.col("shipmentStatus") == "Complete") | (F.col(f"{side}Status") == "Succeeded")


def contains_any(column: str, parts: Iterable[str]) -> Column:
    """The text holds one of the spellings, case sensitively."""
    return reduce(lambda a, b: a | b, [F.col(column).contains(p) for p in parts])


def customer_view() -> Column:
    """Customers see main rows only."""
    return F.col("mainShipment") == "YES"


def transport_leg() -> Column:
    """Legs that move freight: cross-dock handling is left out of counts."""
    return ~F.coalesce(F.col("pickLocationName") == F.col("dropLocationName"), F.lit(False))


def detail_rows(shipment_type: str) -> Column:
    """Rows a drill-down lists: truckload rows of every kind, parcel main rows."""
    truckload = F.col("shipmentType").isin("Full Truckload", "Less Than Truckload")
    parcel = (F.col("shipmentType") == "Parcel") & customer_view()
    if shipment_type == ALL_TYPES:
        return truckload | parcel
    return (F.col("shipmentType") == shipment_type) & (truckload | parcel)


def delivered_between(query: LegQuery) -> Column:
    moment = F.col("delivery_ts")
    if query.inclusive_end:
        after = dt.date.fromisoformat(query.end) + dt.timedelta(days=1)
        return (moment >= midnight(query.start)) & (moment < midnight(after))
    return (moment >= midnight(query.start)) & (moment <= midnight(query.end))


def matching(enriched: DataFrame, query: LegQuery) -> DataFrame:
    """Rows within the date range that pass the optional filters.

    Where the frame carries the stored ``delivery_date`` partition column, the
    range is put on it too, so that only those directories are listed and read.
    """
    rows = enriched.filter(delivered_between(query))
    if "delivery_date" in enriched.columns:
        day = F.col("delivery_date")
        rows = rows.filter((day >= F.lit(query.start).cast("date")) & (day <= F.lit(query.end).cast("date")))
    if query.shipment_type != ALL_TYPES:
        rows = rows.filter(F.col("shipmentType") == query.shipment_type)
    if query.customers:
        rows = rows.filter(F.col("clientName").isin(*query.customers))
    if query.exclude_customers:
        rows = rows.filter(~F.col("clientName").isin(*query.exclude_customers))
    if query.lanes:
        rows = rows.filter(F.col("lane").isin(*query.lanes))
    if not query.include_crossdock:
        rows = rows.filter(transport_leg())
    return rows


def population(enriched: DataFrame, query: LegQuery, keys: tuple[str, ...] = MARKETS) -> DataFrame:
    """The standard population of a report, with both lane ends known."""
    rows = matching(enriched, query).filter(standard_population())
    return rows.filter(keys_present(*keys)) if keys else rows
