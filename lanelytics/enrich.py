"""Derived columns that every report starts from."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from lanelytics.functions.labels import lane_label
from lanelytics.functions.money import counted, is_crossdock, is_tonu
from lanelytics.functions.times import delivery_time, event_time

EVENT_TIMES = {
    "pick_arrived_ts": "pickTimeArrived",
    "pick_from_ts": "pickWindowFrom",
    "pick_to_ts": "pickWindowTo",
    "drop_arrived_ts": "dropTimeArrived",
    "drop_from_ts": "dropWindowFrom",
    "drop_to_ts": "dropWindowTo",
    "load_booked_ts": "loadBookedTime",
}


def with_event_times(legs: DataFrame, names: Iterable[str] = tuple(EVENT_TIMES), lenient: bool = False) -> DataFrame:
    """Legs with parsed times, or some of them by name."""
    return legs.withColumns({name: event_time(F.col(EVENT_TIMES[name]), lenient) for name in names})


def with_delivery_time(timed: DataFrame) -> DataFrame:
    """Legs with parsed times of arrival and window, and the delivery time.

    The delivery time is generated, not projected.  Spark moves filters below
    projections and then works out the columns anew for each comparison, in
    code too long to be compiled; a generated column is worked out once.
    Filters on it stay above it: where legs are joined, give the side that has
    the times its delivery time first, and the filters meet that side before
    it is shuffled.
    """
    made = timed.drop("delivery_ts").select("*", F.explode(F.array(delivery_time())).alias("delivery_ts"))
    return made.select(*timed.columns) if "delivery_ts" in timed.columns else made


def with_flags(timed: DataFrame) -> DataFrame:
    """Legs with flags, counted money and lane."""
    return timed.withColumns(
        {
            "is_crossdock": is_crossdock(),
            "is_tonu": is_tonu(),
            "counted_revenue": counted(F.col("revenueAllocationNumber")),
            "counted_cost": counted(F.col("costAllocationNumber")),
            "lane": lane_label("startMarket", "endMarket"),
        }
    )


def enrich(legs: DataFrame, lenient: bool = False) -> DataFrame:
    """Legs with parsed times, delivery time, flags, counted money and lane.

    Row by row: columns that a report does not use are pruned, so the same
    frame serves all of them, read live or stored by ``write_enriched``.
    """
    return with_flags(with_delivery_time(with_event_times(legs, lenient=lenient)))
