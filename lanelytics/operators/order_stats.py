"""Per-order row counts, and the rows that reports count by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lanelytics.operators.groups import lookup_join, with_group_sums


def with_order_counts(rows: DataFrame, keys: Sequence[str] = ("orderCode",)) -> DataFrame:
    """Rows with their order's row, main-row and sub-row counts.

    Counting within one carrier takes ``("orderCode", "carrierName")``.
    """
    main = F.col("mainShipment")
    return with_group_sums(
        rows,
        keys,
        {
            "order_rows": F.lit(1),
            "order_main_rows": F.when(main == "YES", 1).otherwise(0),
            "order_sub_rows": F.when(main == "NO", 1).otherwise(0),
        },
    )


def multidrop_orders(rows: DataFrame) -> DataFrame:
    """(orderCode, multidrop): whether several main rows of the order share a load."""
    per_load = rows.groupBy("orderCode", "loadId").agg(F.count_if(F.col("mainShipment") == "YES").alias("main_rows"))
    shared = (F.col("main_rows") > 1) & F.col("loadId").isNotNull()
    return per_load.groupBy("orderCode").agg(F.max(shared).alias("multidrop"))


def counted_shipments(legs: DataFrame, carrier: str | None = None) -> DataFrame:
    """Less-than-truckload rows that count as a carrier's shipments.

    Of an order with several rows only the sub-shipments count, of any other
    its one row.  Rows are counted within each carrier's part of the order.
    """
    rows = legs.filter(F.col("shipmentType") == "Less Than Truckload")
    rows = rows.filter(F.col("carrierName") == carrier) if carrier is not None else rows
    counted = with_order_counts(rows, ("orderCode", "carrierName"))
    return counted.filter(
        ((F.col("order_rows") > 1) & (F.col("mainShipment") == "NO")) | (F.col("order_rows") == 1)
    )


def ftl_structure(multidrop: Column, main_rows: Column, sub_rows: Column, all_rows: Column) -> Column:
    """Full-truckload order classes by row counts.

    Direct orders are a single main row, multidrop ones have several main rows
    on one load, and multistop ones a main row with sub-shipments.
    """
    return (
        F.when((main_rows == 1) & (all_rows == 1), F.lit("direct"))
        .when(multidrop, F.lit("multidrop"))
        .when((main_rows == 1) & (sub_rows >= 1), F.lit("multistop"))
        .otherwise(F.lit("other"))
    )


def rows_to_use(legs: DataFrame, report: str) -> DataFrame:
    """The rows a ``customer`` or ``carrier`` report counts.

    Customers see main rows.  Carriers see, of less-than-truckload orders, the
    sub-shipments or the only row, and of all other orders every row: a
    multidrop order consists of its main rows, a multistop one sums all rows.
    """
    if report == "customer":
        return legs.filter(F.col("mainShipment") == "YES")
    if report != "carrier":
        raise ValueError(f"report must be 'customer' or 'carrier', not {report!r}")
    counted = lookup_join(with_order_counts(legs), multidrop_orders(legs), "orderCode")
    ltl = F.coalesce(F.col("shipmentType") == "Less Than Truckload", F.lit(False))
    multidrop = (F.col("shipmentType") == "Full Truckload") & F.col("multidrop")
    keep = (
        F.when(ltl, (F.col("order_rows") == 1) | (F.col("mainShipment") == "NO"))
        .when(multidrop, F.col("mainShipment") == "YES")
        .otherwise(F.lit(True))
    )
    return counted.filter(keep)
