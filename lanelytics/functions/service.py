"""On-time rules for one enriched leg."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ON_TIME = "On Time"
LATE = "Late"

# The service targets in percent.
TARGETS = {"OTP": 98.5, "OTD": 99.9, "OTD (some reports)": 98.0, "Tracking": 100.0}


def arrived(side: str) -> Column:
    """Arrival time at an enriched leg's ``pick`` or ``drop`` end."""
    return F.col(f"{side}_arrived_ts")


def window_start(side: str) -> Column:
    return F.col(f"{side}_from_ts")


def window_end(side: str) -> Column:
    return F.col(f"{side}_to_ts")


def _status(late: Column) -> Column:
    return F.when(late, F.lit(LATE)).when(~late, F.lit(ON_TIME))


def on_time(side: str) -> Column:
    """Whether a leg arrived before its window ended; unknown times are late."""
    return F.coalesce(arrived(side) < window_end(side), F.lit(False))


def on_time_status(side: str) -> Column:
    """``On Time`` if the arrival is before the window's end, else ``Late``."""
    return F.when(on_time(side), F.lit(ON_TIME)).otherwise(F.lit(LATE))


def status_by_clock(side: str, hour: int, minute: int = 0) -> Column:
    """Late after a clock time on the scheduled day; NULL if a time is unknown."""
    cutoff = window_start(side).cast("date").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.lit(hour), mins=F.lit(minute)
    )
    return _status(arrived(side) > cutoff)


def status_by_hours(side: str, hours: int) -> Column:
    """Late if more than ``hours`` after the window's start."""
    return _status(arrived(side) > window_start(side) + F.make_dt_interval(hours=F.lit(hours)))


def status_by_grace(side: str, minutes: int) -> Column:
    """Late if more than ``minutes`` past the window's end."""
    return _status(arrived(side) > window_end(side) + F.make_dt_interval(mins=F.lit(minutes)))


def delay_code(side: str, status: Column) -> Column:
    """The recorded delay code; a late leg without one is the carrier's failure."""
    code = F.col({"pick": "pickupDelayCode", "drop": "deliveryDelayCode"}[side])
    empty = code.isNull() | (code == "")
    return F.when((status == LATE) & empty, F.lit("Carrier Failure")).otherwise(code)
