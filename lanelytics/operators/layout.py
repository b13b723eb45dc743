"""Row order within a table by several columns at once.

Sorting by lane lets a reader skip by lane and no other column.  Here each
column is cut into ranges, and the bits of the range numbers are interleaved:
rows that are near each other in every column are near in the result, so the
smallest and largest values that Parquet keeps per row group and page exclude
most of a table whichever of the columns a filter names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a range number.
BITS = 6


def _range_of(rows: DataFrame, column: str) -> Column:
    """A scalar array of bounds: the values of a column with the smallest hashes, as many as ranges need."""
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    sample = values.orderBy(F.xxhash64("v"), "v").limit(2**BITS - 1)
    return sample.agg(F.collect_list("v")).scalar()


def _reached(bounds: str, column: str) -> Column:
    """The share of the bounds that a value reaches, as a number of ``BITS`` bits."""
    number = F.size(F.filter(bounds, lambda bound: F.coalesce(bound <= F.col(column), F.lit(False))))
    return F.floor(number * 2**BITS / (F.size(bounds) + 1)).cast("bigint")


def with_curve(rows: DataFrame, columns: Sequence[str], name: str = "_curve") -> DataFrame:
    """Rows with their place on the curve, first columns foremost; NULL is in the first range of a column."""
    bounded = rows
    for n, column in enumerate(columns):
        bounded = bounded.withColumn(f"_bounds_{n}", _range_of(rows, column))
    bits = []
    for n, column in enumerate(columns):
        bounded = bounded.withColumn(f"_range_{n}", _reached(f"_bounds_{n}", column))
        for bit in range(BITS):
            one = F.shiftright(F.col(f"_range_{n}"), bit).bitwiseAND(F.lit(1))
            bits.append(F.shiftleft(one, (bit + 1) * len(columns) - 1 - n))
    helpers = [f"_{kind}_{n}" for kind in ("bounds", "range") for n in range(len(columns))]
    return bounded.withColumn(name, reduce(Column.__add__, bits)).drop(*helpers)
