"""Exact distinct order counts of any date range, from states stored per day.

Distinct counts of days cannot be added up: an order may have legs on several.
Bitmaps can: orders are numbered once, each day, shipment type and lane keeps
the sums over its legs and one bit per order that has a leg there, and a range
is answered by the union of the bitmaps of its days.  No leg is read again.

A state row covers ``SPAN`` consecutive order numbers, so bitmaps are short;
they are built and united as words of 64 bits, since Spark's own bitmap
aggregates sort and shuffle 4,096 bytes a group however short the result is.
Orders are numbered by first day and lane, so that the orders of a day and
lane stand in few spans.  The union is spread by lane and span before it is
counted by lane: a lane with a third of all orders is no single group.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.functions.labels import lane_label
from lanelytics.operators.predicates import MARKETS, keys_present, standard_population
from lanelytics.operators.ranks import with_places
from lanelytics.operators.rollup import SUMS, leg_sums, with_profit
from lanelytics.query import ALL_TYPES, LegQuery

SPAN, WORD = 512, 64
STATE_KEYS = ("delivery_date", "at_midnight", "shipmentType", *MARKETS)
#: Distinct orders of a state: all, and those with a leg of a status.
ORDERS = {"order_count": None, "completed_orders": "Complete", "canceled_orders": "canceled"}


def number_orders(enriched: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(orderCode, order_no) of the orders not yet ``known``, numbered from 0 or behind the known ones.

    NULL is no order.  Numbers once given stay: store the result, and append that of later legs.
    """
    orders = (
        enriched.filter(F.col("orderCode").isNotNull())
        .groupBy("orderCode")
        .agg(F.min(F.to_date("delivery_ts")).alias("first_day"), F.min(F.xxhash64(*MARKETS)).alias("lane_hash"))
    )
    next_number = F.lit(0).cast("bigint")
    if known is not None:
        orders = orders.join(known.select("orderCode"), "orderCode", "left_anti")
        next_number = known.agg(F.coalesce(F.max("order_no") + 1, F.lit(0).cast("bigint"))).scalar()
    placed = with_places(orders, ("first_day", "lane_hash", "orderCode"))
    return placed.select("orderCode", (F.col("place") - 1 + next_number).alias("order_no"))


def order_states(enriched: DataFrame, numbers: DataFrame) -> DataFrame:
    """The states of the counted legs with a delivery time and both markets, by day, type, lane and span.

    Legs at midnight have states of their own, since a range ends at midnight of its last day.
    """
    rows = enriched.filter(standard_population() & keys_present(*MARKETS) & F.col("delivery_ts").isNotNull())
    numbered = rows.join(numbers, "orderCode", "left").withColumns(
        {
            "delivery_date": F.to_date("delivery_ts"),
            "at_midnight": F.col("delivery_ts") == F.to_date("delivery_ts").cast("timestamp_ntz"),
            "span": F.floor(F.col("order_no") / SPAN),
            "bit": F.col("order_no") % SPAN,
        }
    )

    # the bits of a byte count from its lowest, as in Spark's bitmaps, the bytes of a word from its highest
    bit = F.col("bit").cast("int") % WORD
    shift = (F.lit(WORD - 8) - F.floor(bit / 8) * 8 + bit % 8).cast("int")
    in_word = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    worded = numbered.withColumns({"word": F.floor(F.col("bit") / WORD), "in_word": in_word})

    def words(name: str, status: str | None) -> list[Column]:
        has = F.lit(True) if status is None else F.col("shipmentStatus") == status
        return [
            F.coalesce(F.bit_or(F.when(has & (F.col("word") == k), F.col("in_word"))), F.lit(0).cast("bigint")).alias(f"{name}_{k}")
            for k in range(SPAN // WORD)
        ]

    grouped = worded.groupBy(*STATE_KEYS, "span").agg(*leg_sums(), *[w for name, status in ORDERS.items() for w in words(name, status)])
    bitmaps = [_joined(name).alias(name) for name in ORDERS]
    return grouped.select(*STATE_KEYS, "span", *SUMS, *bitmaps)


def _joined(name: str) -> Column:
    """The words of a bitmap as bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(f"{name}_{k}"), WORD // 4, "0") for k in range(SPAN // WORD)]))


def _word(name: str, k: int) -> Column:
    """One word of a bitmap of bytes; one that is shorter goes on with zeros."""
    digits = F.rpad(F.hex(F.substring(name, k * WORD // 8 + 1, WORD // 8)), WORD // 4, "0")
    return F.conv(digits, 16, -10).cast("bigint")


def _within(query: LegQuery) -> Column:
    day, first, last = F.col("delivery_date"), dt.date.fromisoformat(query.start), dt.date.fromisoformat(query.end)
    whole = day <= last if query.inclusive_end else (day < last) | ((day == last) & F.col("at_midnight"))
    return (day >= first) & (day <= last) & whole


def states_rollup(states: DataFrame, query: LegQuery, keys: Sequence[str] = MARKETS) -> DataFrame:
    """What ``profit_rollup`` gives for the legs of a query, from their states."""
    if query.customers or query.exclude_customers or not query.include_crossdock:
        raise ValueError("states tell days, shipment types and lanes apart, not customers or cross-dock legs")
    rows = states.filter(_within(query))
    if query.shipment_type != ALL_TYPES:
        rows = rows.filter(F.col("shipmentType") == query.shipment_type)
    if query.lanes:
        rows = rows.filter(lane_label(*MARKETS).isin(*query.lanes))
    words = {f"{name}_{k}": _word(name, k) for name in ORDERS for k in range(SPAN // WORD)}
    united = rows.withColumns(words).groupBy(*keys, "span").agg(
        *[F.sum(name).alias(name) for name in SUMS], *[F.bit_or(word).alias(word) for word in words]
    )
    counts = {name: sum((F.coalesce(F.bit_count(f"{name}_{k}"), F.lit(0)) for k in range(SPAN // WORD)), F.lit(0).cast("bigint")) for name in ORDERS}
    by_span = united.withColumns(counts)
    return with_profit(by_span.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in (*SUMS, *ORDERS)]))
