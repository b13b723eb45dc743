"""First occurrence per stop.

The main row of an order repeats the pickup of its first leg and the delivery
of its last one, so a carrier's stops are counted once per load, carrier, site
and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanelytics.functions.service import arrived


#: Parts that the rows of a stop are dealt to.
SHARES = 32


def stop_key(side: str) -> list[Column]:
    """What makes rows the same stop at the ``pick`` or ``drop`` end."""
    return [F.col("loadId"), F.col("carrierName"), F.col(f"{side}LocationName"), arrived(side).cast("date")]


def first_per_stop(rows: DataFrame, side: str) -> DataFrame:
    """The earliest row of each stop; ties go to the lowest leg id.

    A filter on the first row number is applied within each partition before
    the shuffle as well, so a stop with very many rows shrinks to one row per
    task before it is gathered.
    """
    order = Window.partitionBy(*stop_key(side)).orderBy(arrived(side), "warpId")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def with_keep_flags(rows: DataFrame) -> DataFrame:
    """Rows with ``keep_for_pickup`` and ``keep_for_delivery``: exactly one row of each stop is the first.

    A stop is numbered in ``SHARES`` by leg id, and then the first rows of its
    shares among themselves, while the others stay in their shares: no task
    sorts all rows of a stop, however many it has.  Pickups and deliveries share
    the load and the carrier, so that one shuffle serves the shares of both.
    """
    ends = (("pick", "keep_for_pickup"), ("drop", "keep_for_delivery"))
    share = F.pmod(F.xxhash64("warpId"), F.lit(SHARES))
    flagged = rows.withColumn("_share", share).repartition("loadId", "carrierName", "_share")
    for side, flag in ends:
        in_share = Window.partitionBy(*stop_key(side), "_share").orderBy(arrived(side), "warpId")
        flagged = flagged.withColumn(flag, F.row_number().over(in_share) == 1)
    for side, flag in ends:
        flagged = flagged.withColumn("_group", F.when(F.col(flag), F.lit(-1)).otherwise(F.col("_share")))
        firsts = Window.partitionBy(*stop_key(side), "_group").orderBy(arrived(side), "warpId")
        flagged = flagged.withColumn(flag, F.col(flag) & (F.row_number().over(firsts) == 1))
    return flagged.drop("_share", "_group")
