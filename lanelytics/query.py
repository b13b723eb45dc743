"""The filters a report is asked for."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

ALL_TYPES = "All"


@dataclass(frozen=True)
class LegQuery:
    """Date range and optional filters of a report.

    The range ends at midnight of ``end``, so later events of that day are
    outside it; ``inclusive_end`` takes in the whole day.
    """

    start: str
    end: str
    shipment_type: str = ALL_TYPES
    customers: tuple[str, ...] = ()
    exclude_customers: tuple[str, ...] = ()
    lanes: tuple[str, ...] = ()
    include_crossdock: bool = True
    inclusive_end: bool = False

    @classmethod
    def last_days(cls, as_of: dt.date, days: int = 30, **filters) -> LegQuery:
        """The ``days`` up to ``as_of``: 30 for summaries, 90 for diagnostics."""
        return cls(str(as_of - dt.timedelta(days=days)), str(as_of), **filters)
