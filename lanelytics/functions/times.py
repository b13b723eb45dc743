"""Event times: text to timestamps, the effective delivery time, periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# How the source writes its times and dates, and their ISO order.
# Text of any other shape turns into separators only, which no cast accepts.
EVENT_TIME = (r"^(?:(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{2}:\d{2})|[\s\S]*)$", "$3-$1-$2 $4")
EVENT_DATE = (r"^(?:(\d{1,2})/(\d{1,2})/(\d{4})|[\s\S]*)$", "$3-$1-$2")
ISO_DATE = (r"^(?:(\d{4}-\d{2}-\d{2})[\s\S]*|[\s\S]*)$", "$1")


# The same with two digits in each part, as nearly all text is.
FULL_TIME = r"\A\d\d/\d\d/\d{4} \d\d:\d\d:\d\d\z"


def _reshaped(text: Column, shape: tuple[str, str], to: str) -> Column:
    return F.regexp_replace(text, shape[0], shape[1]).try_cast(to)


def event_date(text: Column) -> Column:
    """``MM/dd/yyyy`` text, or with one-digit parts, as a midnight timestamp; anything else is NULL."""
    return _reshaped(text, EVENT_DATE, "timestamp_ntz")


def event_time(text: Column, lenient: bool = False) -> Column:
    """``MM/dd/yyyy HH:mm:ss`` text, or with one-digit parts, as a timestamp; anything else is NULL.

    The text is put in ISO order and cast, which needs no time zone and so
    never shifts an hour that a zone skips.  ``lenient`` also accepts text that
    holds the date only.  Text in its full length is put in order by position,
    which costs less than by groups.
    """
    day = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 1, 2), F.lit("-"), F.substring(text, 4, 2))
    full = F.concat(day, F.substring(text, 11, 9)).try_cast("timestamp_ntz")
    parsed = F.when(text.rlike(FULL_TIME), full).otherwise(_reshaped(text, EVENT_TIME, "timestamp_ntz"))
    return F.coalesce(parsed, event_date(text)) if lenient else parsed


def iso_date(text: Column) -> Column:
    """Text that starts with ``yyyy-MM-dd`` as a date."""
    return _reshaped(text, ISO_DATE, "date")


def present(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def delivery_time() -> Column:
    """When a leg with parsed times counts as delivered.

    A cross-dock leg counts at its scheduled window; any other leg at its
    arrival time, else its arrival date, else its scheduled window.  The first
    source that is present decides, even if its text could not be read.
    """
    scheduled = F.col("drop_from_ts")
    return (
        F.when(F.col("pickLocationName") == F.col("dropLocationName"), scheduled)
        .when(F.col("dropTimeArrived") != "", F.col("drop_arrived_ts"))
        .when(F.col("dropDateArrived") != "", event_date(F.col("dropDateArrived")))
        .otherwise(scheduled)
    )


def in_previous_week(moment: Column, as_of: dt.date) -> Column:
    """Within the ISO week before the one that holds ``as_of``."""
    monday = as_of - dt.timedelta(days=as_of.weekday())
    return half_open(moment, monday - dt.timedelta(days=7), monday)


def in_previous_month(moment: Column, as_of: dt.date) -> Column:
    """Within the calendar month before the one that holds ``as_of``."""
    first = as_of.replace(day=1)
    return half_open(moment, (first - dt.timedelta(days=1)).replace(day=1), first)


def half_open(moment: Column, start: dt.date | str, end: dt.date | str) -> Column:
    """``start <= moment < end``, both at midnight."""
    return (moment >= midnight(start)) & (moment < midnight(end))


def midnight(day: dt.date | str) -> Column:
    return F.lit(str(day)).cast("timestamp_ntz")


def week_of(moment: Column) -> Column:
    """The Monday of a timestamp's ISO week, as a date."""
    return F.trunc(moment.cast("date"), "week")


def month_of(moment: Column) -> Column:
    """The first day of a timestamp's month, as a date."""
    return F.trunc(moment.cast("date"), "month")
