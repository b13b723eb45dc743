"""Freight lane profitability analytics as Spark DataFrame plans."""

from lanelytics.enrich import enrich
from lanelytics.query import LegQuery

__all__ = ["LegQuery", "enrich"]
