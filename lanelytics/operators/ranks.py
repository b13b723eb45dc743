"""Places of rows in a total order, without one task that holds them all.

A row number over all rows is a window without partitions: one task sorts
everything.  Here the rows are dealt to ranges by the values they are ordered
by, the rows of each range are counted, and a row's place is the number of
rows in the ranges before its own plus its number inside.  The bounds of the
ranges are values of the rows themselves, those with the smallest hashes, so
that ranges are of similar size whatever the values; ranges depend on values
alone, not on how Spark happens to split its work, so a task that runs again
gives the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges that rows are dealt to.
RANGES = 64


def _not_after(bound: Column, row: Column, order: Sequence[str]) -> Column:
    """Whether a bound comes before a row or is its equal; NULL is below every value."""
    result = F.lit(True)
    for n, name in reversed(list(enumerate(order))):
        low, high = (row, bound) if name.startswith("-") else (bound, row)
        low, high = low[f"k{n}"], high[f"k{n}"]
        less = (low.isNull() & high.isNotNull()) | F.coalesce(low < high, F.lit(False))
        result = less | (low.eqNullSafe(high) & result)
    return result


def sort_columns(order: Sequence[str], columns: Sequence[Column] | None = None) -> list[Column]:
    """An order as columns to sort by, NULL as the smallest value."""
    columns = [F.col(name.removeprefix("-")) for name in order] if columns is None else columns
    return [c.desc() if name.startswith("-") else c.asc() for c, name in zip(columns, order)]


def with_places(rows: DataFrame, order: Sequence[str], name: str = "place", ranges: int = RANGES) -> DataFrame:
    """Rows with their place, from 1, in the order of some columns; ``-`` before a name means largest first.

    The columns must tell rows apart and be exact (no sums of floating-point numbers).  The rows are evaluated
    for the bounds, for the counts and for the result: store a frame first that is costly to derive.
    """
    key = F.struct(*[F.col(column.removeprefix("-")).alias(f"k{n}") for n, column in enumerate(order)])
    keyed = rows.withColumn("_key", key)
    sample = keyed.select("_key", F.xxhash64("_key").alias("hash")).orderBy("hash", "_key").limit(ranges - 1)
    bounds = sample.agg(F.collect_list("_key")).scalar()
    part = F.size(F.filter("_bounds", lambda bound: _not_after(bound, F.col("_key"), order)))
    dealt = keyed.withColumn("_bounds", bounds).withColumn("_range", part).drop("_bounds")
    counted = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))

    def before(number: Column) -> Column:
        return F.aggregate(
            F.filter("counts", lambda c: c["_range"] < number), F.lit(0).cast("bigint"), lambda total, c: total + c["n"]
        )

    counts = counted.agg(F.collect_list(F.struct("_range", "n")).alias("counts"))
    offsets = counts.select(F.transform(F.sequence(F.lit(0), F.lit(ranges)), before)).scalar()
    sorted_by = sort_columns(order, [F.col(f"_key.k{n}") for n in range(len(order))])
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*sorted_by))
    numbered = dealt.withColumn("_inside", inside).withColumn("_offsets", offsets)
    return numbered.withColumn(name, F.get("_offsets", F.col("_range")) + F.col("_inside")).drop(
        "_key", "_range", "_inside", "_offsets"
    )
