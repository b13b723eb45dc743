"""Approximate distinct counts from stored, mergeable sketches.

One sketch per key and day is a few kilobytes however many values it has seen,
and the union of sketches is the sketch of the union, so any range of days is
estimated without reading legs.  Exact counts of orders come from bitmaps
(``order_states``); sketches suit values that nobody has numbered, such as
lane labels or leg ids.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

#: Logarithm of the number of registers of a sketch.
REGISTERS = 12


def error_bound(registers: int = REGISTERS, deviations: int = 3) -> float:
    """The relative error that an estimate stays within, for a number of standard deviations."""
    return deviations * 1.04 / sqrt(2**registers)


def distinct_sketches(
    rows: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = (), registers: int = REGISTERS
) -> DataFrame:
    """A sketch per key of each of the named text values; NULL is no value."""
    return rows.groupBy(*keys).agg(*[F.hll_sketch_agg(value, registers).alias(name) for name, value in values.items()])


def estimates(sketches: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values per key, over all sketches with that key; 0 if there is none."""
    union = lambda name: F.hll_sketch_estimate(F.hll_union_agg(name))
    return sketches.groupBy(*keys).agg(*[F.coalesce(union(name), F.lit(0)).alias(name) for name in names])
