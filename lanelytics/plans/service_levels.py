"""On-time pickup and delivery, bookings and delay reasons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.labels import equipment_add_ons, equipment_class, lane_label
from lanelytics.functions.service import (
    LATE,
    ON_TIME,
    TARGETS,
    arrived,
    delay_code,
    on_time,
    on_time_status,
    window_start,
)
from lanelytics.functions.times import half_open, in_previous_week, present
from lanelytics.operators.dedup import first_per_stop
from lanelytics.operators.order_stats import counted_shipments
from lanelytics.operators.predicates import MARKETS, completed_work, contains_any, customer_view, transport_leg


def _rate(side: str) -> list[Column]:
    """Rows, rows on time and their share in percent with one decimal."""
    hits = F.count(F.when(on_time(side), 1))
    rows = F.count(F.lit(1))
    name = {"pick": ("total_pickups", "otp_pct"), "drop": ("total_deliveries", "otd_pct")}[side]
    share = F.round(hits * 100 / rows, 1)
    return [rows.alias(name[0]), hits.alias("on_time"), share.alias(name[1])]


def _timed(legs: DataFrame, side: str) -> DataFrame:
    return legs.filter(F.col(f"{side}TimeArrived").isNotNull() & F.col(f"{side}WindowTo").isNotNull())


def carrier_stops(
    legs: DataFrame,
    side: str,
    carrier: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
) -> DataFrame:
    """A carrier's completed stops, each counted once.

    ``start`` and ``end`` bound the scheduled time as a half-open range.
    """
    rows = _timed(legs, side).filter(completed_work(side))
    if carrier is not None:
        rows = rows.filter(F.col("carrierName") == carrier)
    if start is not None and end is not None:
        rows = rows.filter(half_open(window_start(side), start, end))
    return first_per_stop(rows, side)


def carrier_on_time(legs: DataFrame, side: str = "pick", **filters) -> DataFrame:
    """Carrier view: on-time share by shipment type over deduplicated stops."""
    return carrier_stops(legs, side, **filters).groupBy("shipmentType").agg(*_rate(side))


def _customer_rows(legs: DataFrame, side: str, customer: str | None, as_of: dt.date | None) -> DataFrame:
    rows = _timed(legs, side).filter(customer_view() & (F.col("shipmentStatus") == "Complete"))
    if customer is not None:
        rows = rows.filter(F.col("clientName") == customer)
    if as_of is not None:
        rows = rows.filter(in_previous_week(window_start(side), as_of))
    return rows


def customer_on_time(
    legs: DataFrame, customer: str | None = None, as_of: dt.date | None = None, side: str = "drop"
) -> DataFrame:
    """Customer view: on-time deliveries, or pickups, by lane, equipment and type.

    With ``as_of``, over the ISO week before it, by scheduled time.
    """
    total = {"pick": "total_pickups", "drop": "total_deliveries"}[side]
    return (
        _customer_rows(legs, side, customer, as_of)
        .groupBy(*MARKETS, "equipment", "shipmentType")
        .agg(*_rate(side))
        .withColumn("lane", lane_label(*MARKETS))
        .orderBy(F.desc(total), "lane", "equipment", "shipmentType")
    )


def customer_on_time_pivot(
    legs: DataFrame, equipment: tuple[str, ...], customer: str | None = None, as_of: dt.date | None = None
) -> DataFrame:
    """On-time deliveries in percent per lane, one column per equipment and one for all others."""
    rows = _customer_rows(legs, "drop", customer, as_of).withColumn("lane", lane_label(*MARKETS))
    hit = F.when(on_time("drop"), 100.0).otherwise(0.0)
    named = F.when(F.col("equipment").isin(*equipment), F.col("equipment")).otherwise(F.lit("other"))
    kinds = rows.withColumn("equipment", named).groupBy("lane").pivot("equipment", [*equipment, "other"])
    return kinds.agg(F.avg(hit)).orderBy("lane")


def site_on_time(legs: DataFrame, spellings: tuple[str, ...]) -> DataFrame:
    """On-time delivery at drop sites whose name holds one of the spellings."""
    rows = legs.filter(contains_any("dropLocationName", spellings))
    return (
        carrier_stops(rows, "drop")
        .groupBy("dropLocationName", "shipmentType")
        .agg(*_rate("drop"))
        .orderBy(F.desc("total_deliveries"), "dropLocationName", "shipmentType")
    )


def bookings(legs: DataFrame, rep: str | None = None, day: dt.date | str | None = None) -> DataFrame:
    """Shipments booked per sales rep, day and type; all rows count."""
    rows = legs.filter(present(F.col("loadBookedTime")))
    if rep is not None:
        rows = rows.filter(F.col("carrierSaleRep") == rep)
    rows = rows.withColumn("booked_date", F.to_date("load_booked_ts"))
    if day is not None:
        rows = rows.filter(F.col("booked_date") == F.lit(str(day)).cast("date"))
    return (
        rows.groupBy("carrierSaleRep", "booked_date", "shipmentType")
        .agg(F.count(F.lit(1)).alias("shipment_count"))
        .orderBy("carrierSaleRep", "booked_date", "shipmentType")
    )


def status_counts(legs: DataFrame, statuses: dict[str, Column]) -> DataFrame:
    """Transport legs per shipment type and named status rule, late and on time."""
    rows = legs.filter(transport_leg())
    counts = []
    for name, status in statuses.items():
        counts += [
            F.count(F.when(status == ON_TIME, 1)).alias(f"{name}_on_time"),
            F.count(F.when(status == LATE, 1)).alias(f"{name}_late"),
        ]
    return rows.groupBy("shipmentType").agg(*counts)


def delay_reasons(legs: DataFrame, side: str) -> DataFrame:
    """Late transport legs by delay code, the carrier's failure where none is given."""
    rows = _timed(legs, side).filter(transport_leg()).withColumn("status", on_time_status(side))
    return (
        rows.filter(F.col("status") == LATE)
        .groupBy(delay_code(side, F.col("status")).alias("delay_code"))
        .agg(F.count(F.lit(1)).alias("late_legs"))
    )


def carrier_shipment_counts(legs: DataFrame) -> DataFrame:
    """Less-than-truckload shipments per carrier under the counting rule."""
    return counted_shipments(legs).groupBy("carrierName").agg(F.count(F.lit(1)).alias("shipments"))


def equipment_mix(legs: DataFrame) -> DataFrame:
    """Legs per equipment class and add-ons."""
    equipment = F.col("equipment")
    return legs.groupBy(
        equipment_class(equipment).alias("equipment_class"),
        *[column.alias(name) for name, column in equipment_add_ons(equipment).items()],
    ).agg(F.count(F.lit(1)).alias("legs"))


def service_against_targets(legs: DataFrame) -> DataFrame:
    """Overall on-time shares against their targets.

    Tracking is the share of completed stops with a known arrival time.
    Legs are read once: each gives a row for either stop it counts for and one for tracking.  The first of a stop is
    found by an aggregate, which shrinks the rows of a stop, and all rows of tracking, before they are shuffled.
    """

    def stop(kind: str, side: str) -> Column:
        site, moment = F.col(f"{side}LocationName"), arrived(side)
        keys = (F.col("loadId").alias("load"), F.col("carrierName").alias("carrier"), site.alias("site"), moment.cast("date").alias("day"))
        row = F.struct(F.lit(kind).alias("kind"), *keys, moment.alias("moment"), F.col("warpId").alias("leg"), on_time(side).alias("hit"))
        timed = F.col(f"{side}TimeArrived").isNotNull() & F.col(f"{side}WindowTo").isNotNull()
        return F.when(timed & completed_work(side), row)

    known = F.coalesce(present(F.col("pickTimeArrived")) & present(F.col("dropTimeArrived")), F.lit(False))
    text, day, moment = (F.lit(None).cast(kind) for kind in ("string", "date", "timestamp_ntz"))
    keys = (text.alias("load"), text.alias("carrier"), text.alias("site"), day.alias("day"))
    tracked = F.struct(F.lit("Tracking").alias("kind"), *keys, moment.alias("moment"), text.alias("leg"), known.alias("hit"))
    done = F.when(F.col("shipmentStatus") == "Complete", tracked)
    rows = legs.select(F.explode(F.array(stop("OTP", "pick"), stop("OTD", "drop"), done)).alias("row"))
    stops = (
        rows.filter(F.col("row").isNotNull())
        .select("row.*")
        .groupBy("kind", "load", "carrier", "site", "day")
        .agg(F.min(F.struct("moment", "leg", "hit")).alias("first"), F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("hits"))
    )
    kind, by_row = F.col("kind"), F.col("kind") == "Tracking"
    counts = stops.select(
        kind,
        F.when(by_row, F.col("rows")).otherwise(F.lit(1)).alias("rows"),
        F.when(by_row, F.col("hits")).otherwise(F.col("first.hit").cast("long")).alias("hits"),
    )
    kinds = {"OTP": "OTP", "OTD": "OTD", "OTD (some reports)": "OTD", "Tracking": "Tracking"}
    totals = counts.agg(
        *[F.sum(F.when(kind == k, F.col(c))).alias(f"{k} {c}") for k in dict.fromkeys(kinds.values()) for c in ("rows", "hits")]
    )
    shares = [
        F.struct(
            F.lit(name).alias("kpi"),
            F.lit(TARGETS[name]).alias("target_pct"),
            F.when(F.col(f"{k} rows") > 0, F.col(f"{k} hits") * 100 / F.col(f"{k} rows")).alias("actual_pct"),
        )
        for name, k in kinds.items()
    ]
    every = totals.select(F.explode(F.array(*shares)).alias("t")).select("t.*")
    return every.withColumn("met", F.col("actual_pct") >= F.col("target_pct"))
