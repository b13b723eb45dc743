"""Exact interpolated percentiles without gathering the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranks of the built-in sketch are off by at most one part in this many.
ACCURACY = 100_000
#: Groups of up to this many rows are ranked whole.
SMALL = 1_000_000


def exact_percentiles(
    rows: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated percentiles per key, one row per probability.

    One lazy plan.  The sketch brackets each percentile by two values; its
    error is bounded, so the wanted ranks lie between them.  Rows below the
    bracket are only counted, and the few inside it are ranked.  Equal values
    are one counted row, so no frequent value fills a task.  NULL values are
    left out, keys must not be NULL.
    """
    keys = list(keys)
    known = rows.filter(F.col(value).isNotNull())
    margin = 3 / ACCURACY + 2 / SMALL  # of the sketch, and of the ranks next to the position
    wanted = [float(p) for p in probabilities]

    def bound(sign: int, whole: Column) -> Column:
        shares = F.array(*[F.lit(min(1.0, max(0.0, p + sign * margin))) for p in wanted])
        sketch = F.percentile_approx(value, shares, ACCURACY)
        return F.when(F.count(F.lit(1)) <= SMALL, F.array_repeat(whole, len(wanted))).otherwise(sketch)

    brackets = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), bound(-1, F.min(value)).alias("lows"), bound(1, F.max(value)).alias("highs")
    )
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    if keys:
        placed = counted.join(brackets, keys)
    else:
        placed = counted.withColumns({name: brackets.select(name).scalar() for name in ("total", "lows", "highs")})

    low, high = F.get("lows", F.col("nth")), F.get("highs", F.col("nth"))
    each = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(wanted) - 1))).alias("nth")).filter(
        F.col(value) <= high
    )
    # what lies below a bracket is one row per task before it is shuffled
    inside = F.when(F.col(value) >= low, F.col(value))
    merged = each.groupBy(*keys, "nth", inside.alias("at")).agg(
        F.sum("copies").alias("copies"), F.first("total").alias("total")
    )
    upto = F.sum("copies").over(Window.partitionBy(*keys, "nth").orderBy(F.col("at").asc_nulls_first()))
    probability = F.get(F.array(*[F.lit(p) for p in wanted]), F.col("nth"))
    ranked = merged.withColumns({"upto": upto, "probability": probability}).withColumns(
        {"from": F.col("upto") - F.col("copies"), "position": F.col("probability") * (F.col("total") - 1)}
    )

    def ranked_at(rank: Column) -> Column:
        return F.max(F.when((F.col("from") <= rank) & (F.col("upto") > rank), F.col("at")))

    below, above = ranked_at(F.floor("position")), ranked_at(F.ceil("position"))
    share = F.max(F.col("position") - F.floor("position"))
    return (
        ranked.groupBy(*keys, "probability")
        .agg(below.alias("below"), above.alias("above"), share.alias("share"))
        .select(
            *keys,
            "probability",
            (F.col("below") + (F.col("above") - F.col("below")) * F.col("share")).alias("value"),
        )
    )
