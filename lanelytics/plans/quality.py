"""Coverage, completeness and plausibility of the leg table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.labels import CITY_ARROW, lane_label
from lanelytics.functions.money import allocated, or_zero
from lanelytics.functions.times import event_date, midnight, present
from lanelytics.operators.predicates import MARKETS, keys_present
from lanelytics.operators.sketches import distinct_sketches, estimates

LANE_FIELDS = ("pickCity", "dropCity", "startMarket", "endMarket")
TIME_FIELDS = ("pickTimeArrived", "dropTimeArrived")


def _revenue() -> Column:
    return F.col("revenueAllocationNumber")


def _cost() -> Column:
    return F.col("costAllocationNumber")


def delivered_since(legs: DataFrame, since: str, shipment_type: str = "Less Than Truckload") -> DataFrame:
    """Completed legs of a type whose arrival date is on or after a day."""
    return legs.filter(
        (F.col("shipmentType") == shipment_type)
        & (F.col("shipmentStatus") == "Complete")
        & (event_date(F.col("dropDateArrived")) >= midnight(since))
    )


def allocation_profile(legs: DataFrame) -> DataFrame:
    """NULL, zero and positive allocations by main flag."""

    def shares(name: str, amount: Column) -> list[Column]:
        return [
            F.count(F.when(amount.isNull(), 1)).alias(f"{name}_null"),
            F.count(F.when(amount == 0, 1)).alias(f"{name}_zero"),
            F.count(F.when(amount > 0, 1)).alias(f"{name}_has_value"),
        ]

    return legs.groupBy("mainShipment").agg(
        F.count(F.lit(1)).alias("total_rows"), *shares("rev", _revenue()), *shares("cost", _cost())
    )


def multi_leg_allocations(legs: DataFrame, limit: int | None = None) -> DataFrame:
    """Allocation totals of shipments with several legs, in shipment order."""
    totals = (
        legs.filter(F.col("shipmentWarpId").isNotNull())
        .groupBy("shipmentWarpId")
        .agg(
            F.count(F.lit(1)).alias("num_legs"),
            F.sum(_revenue()).alias("total_rev_alloc"),
            F.sum(_cost()).alias("total_cost_alloc"),
        )
        .filter(F.col("num_legs") > 1)
    )
    return totals if limit is None else totals.orderBy("shipmentWarpId").limit(limit)


def allocation_frequency(legs: DataFrame, limit: int | None = None) -> DataFrame:
    """Revenue allocations, the most frequent ones first."""
    listed = (
        legs.filter(_revenue().isNotNull())
        .groupBy("revenueAllocationNumber")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "revenueAllocationNumber")
    )
    return listed if limit is None else listed.limit(limit)


def allocated_amounts(legs: DataFrame, sample: int | None = None) -> DataFrame:
    """Rows of shipments with a partial allocation, amounts allocated; of the first ``sample`` ones if it is given."""
    partial = (
        legs.filter((_revenue() != 1) & (_revenue() != 0) & F.col("shipmentWarpId").isNotNull())
        .select("shipmentWarpId")
        .distinct()
    )
    chosen = partial if sample is None else partial.orderBy("shipmentWarpId").limit(sample)
    return (
        legs.join(chosen, "shipmentWarpId", "left_semi")
        .select(
            "shipmentWarpId", "warpId", "mainShipment",
            "revenueAllocationNumber", "costAllocationNumber", "totalRevenue", "totalCost",
            allocated(F.col("totalRevenue"), _revenue()).alias("allocated_revenue"),
            allocated(F.col("totalCost"), _cost()).alias("allocated_cost"),
        )
        .orderBy("shipmentWarpId", "warpId")
    )


def allocation_stats(legs: DataFrame) -> DataFrame:
    """Mean, least and greatest allocation by main flag."""
    stats = []
    for name, amount in (("rev", _revenue()), ("cost", _cost())):
        known = F.count(amount)
        stats += [
            F.when(known > 0, F.sum(amount).cast("double") / known).alias(f"avg_{name}_alloc"),
            F.min(amount).alias(f"min_{name}_alloc"),
            F.max(amount).alias(f"max_{name}_alloc"),
        ]
    return legs.filter(_revenue().isNotNull()).groupBy("mainShipment").agg(*stats)


def field_coverage(
    legs: DataFrame, fields: tuple[str, ...] = LANE_FIELDS, by_main_flag: bool = False
) -> DataFrame:
    """How many rows have each field filled, and in percent."""
    grouped = legs.groupBy("mainShipment") if by_main_flag else legs.groupBy()
    counts = grouped.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count(F.when(present(F.col(f)), 1)).alias(f"has_{f}") for f in fields]
    )
    rows = F.col("total_rows")
    return counts.withColumns(
        {f"pct_{f}": F.when(rows > 0, F.col(f"has_{f}") * 100 / rows) for f in fields}
    )


def distinct_lanes(legs: DataFrame) -> DataFrame:
    """Distinct city lanes next to distinct market lanes.

    Two plain distincts whose one-row counts are put side by side.
    """
    city = legs.select(lane_label("pickCity", "dropCity", CITY_ARROW).alias("l")).distinct()
    market = legs.select(lane_label(*MARKETS, arrow=CITY_ARROW).alias("l")).distinct()
    counted = [
        lanes.agg(F.count("l").alias("lanes")).select(F.lit(kind).alias("kind"), "lanes")
        for kind, lanes in (("city", city), ("market", market))
    ]
    both = counted[0].unionByName(counted[1])
    return both.agg(
        F.max(F.when(F.col("kind") == "city", F.col("lanes"))).alias("city_lanes"),
        F.max(F.when(F.col("kind") == "market", F.col("lanes"))).alias("market_lanes"),
    )


def lane_sketches(legs: DataFrame) -> DataFrame:
    """Sketches of the city lanes, market lanes and legs of each delivery date, to be stored."""
    values = {
        "city_lanes": lane_label("pickCity", "dropCity", CITY_ARROW),
        "market_lanes": lane_label(*MARKETS, arrow=CITY_ARROW),
        "legs": F.col("warpId"),
    }
    return distinct_sketches(legs, values, ["delivery_date"])


def estimated_lanes(sketches: DataFrame, start: str, end: str) -> DataFrame:
    """Estimated distinct city lanes, market lanes and legs of some days, both included, from their sketches."""
    day = F.col("delivery_date")
    wanted = sketches.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))
    return estimates(wanted, ("city_lanes", "market_lanes", "legs"))


def top_lanes(legs: DataFrame, limit: int | None = None) -> DataFrame:
    """Market lanes, those with the most legs first, with plain sums of their amounts."""
    lanes = (
        legs.filter(keys_present(*MARKETS))
        .groupBy(*MARKETS)
        .agg(
            F.count(F.lit(1)).alias("shipments"),
            F.sum(or_zero(_revenue())).alias("revenue"),
            F.sum(or_zero(_cost())).alias("cost"),
        )
        .select(
            lane_label(*MARKETS, arrow=CITY_ARROW).alias("lane"),
            "shipments", "revenue", "cost",
            (F.col("revenue") - F.col("cost")).alias("profit"),
        )
        .orderBy(F.desc("shipments"), "lane")
    )
    return lanes if limit is None else lanes.limit(limit)


def completeness(legs: DataFrame) -> DataFrame:
    """Rows lacking a time or an amount."""
    missing: Mapping[str, str] = {
        "missing_pick_time": "pickTimeArrived",
        "missing_drop_time": "dropTimeArrived",
        "missing_revenue": "revenueAllocationNumber",
    }
    return legs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(name) for name, c in missing.items()],
    )


# What is plausible, per check.
MAX_MARGIN_PCT = 100
REVENUE_RANGE = (50, 10_000)
MAX_ORDER_ROWS = {"Less Than Truckload": 20, "Full Truckload": 10}
MIN_ON_TIME_PCT = 50


def sanity_checks(enriched: DataFrame) -> DataFrame:
    """How many units per shipment type fall outside what is plausible.

    One pass: legs are brought to one row per order and type, then added up.
    """
    margin = (_revenue() - _cost()).cast("double") * 100 / _revenue().cast("double")
    low, high = REVENUE_RANGE
    limit = F.lit(None).cast("int")
    for kind, most in MAX_ORDER_ROWS.items():
        limit = F.when(F.col("shipmentType") == kind, F.lit(most)).otherwise(limit)
    timed = F.col("drop_arrived_ts").isNotNull() & F.col("drop_to_ts").isNotNull()
    per_order = enriched.groupBy("shipmentType", "orderCode").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when((_revenue() != 0) & (F.abs(margin) > MAX_MARGIN_PCT), 1)).alias("margin_out_of_range"),
        F.count(F.when((_revenue() < low) | (_revenue() > high), 1)).alias("revenue_out_of_range"),
        F.count(F.when(or_zero(_cost()) == 0, 1)).alias("without_cost"),
        F.count(F.when(timed, 1)).alias("timed"),
        F.count(F.when(timed & (F.col("drop_arrived_ts") < F.col("drop_to_ts")), 1)).alias("on_time"),
    )
    on_time_pct = F.when(F.col("timed") > 0, F.col("on_time") * 100 / F.col("timed"))
    return (
        per_order.groupBy("shipmentType")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            *[F.sum(n).alias(n) for n in ("rows", "margin_out_of_range", "revenue_out_of_range", "without_cost")],
            F.count(F.when(F.col("rows") > limit, 1)).alias("orders_with_many_rows"),
            F.sum("timed").alias("timed"),
            F.sum("on_time").alias("on_time"),
        )
        .withColumn("on_time_pct", on_time_pct)
        .withColumn("on_time_implausible", F.coalesce(F.col("on_time_pct") < MIN_ON_TIME_PCT, F.lit(False)))
        .drop("timed", "on_time")
    )
