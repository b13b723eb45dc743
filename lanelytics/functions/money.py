"""Money rules for one leg, and ratios over sums."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lanelytics.sources.schema import MONEY


def or_zero(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0).cast(MONEY))


def is_crossdock() -> Column:
    """Handling at one place; unknown when either place is missing."""
    return F.col("pickLocationName") == F.col("dropLocationName")


def is_tonu() -> Column:
    """Truck ordered, not used."""
    return F.col("accessorialType") == "TONU"


def counted(amount: Column) -> Column:
    """The part of a leg's amount that counts towards profit.

    Completed legs count in full, canceled ones only if they are cross-dock
    handling, and a truck ordered but not used at any status.
    """
    status = F.col("shipmentStatus")
    counts = (status == "Complete") | ((status == "canceled") & is_crossdock()) | is_tonu()
    return F.when(counts, or_zero(amount)).otherwise(F.lit(0).cast(MONEY))


def sum_where(condition: Column, amount: Column) -> Column:
    """The sum of an amount over the rows of a group that meet a condition, 0 if none does."""
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0).cast(MONEY))


def profit(revenue: Column, cost: Column) -> Column:
    return or_zero(revenue) - or_zero(cost)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 unless ``whole`` is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``, 0 unless ``whole`` is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(F.lit(0.0))


def percent_or_null(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``, NULL when ``whole`` is zero."""
    return F.when(whole != 0, part.cast("double") * 100 / whole.cast("double"))


def allocated(total: Column, share: Column) -> Column:
    """A total times its allocation, to the cent; no allocation means all of it."""
    return F.round(total * F.coalesce(share, F.lit(1).cast(MONEY)), 2)


def header_amount(text: Column) -> Column:
    """An amount that order headers hold as text, to the cent; unreadable text is NULL."""
    return F.round(text.try_cast(MONEY), 2)
