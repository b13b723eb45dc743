"""Freight tables derived from the TPC-H-like test tables.

Stands in for the leg extract wherever only the test tables are at hand.
Every column is a plain expression over ``lineitem`` joined to its order,
customer and supplier, so the derivation is as scalable as the joins.
Amounts are cast to decimal before they are multiplied, which keeps them exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanelytics.enrich import enrich, with_delivery_time, with_event_times, with_flags
from lanelytics.sources.schema import MONEY

EQUIPMENT = (
    "53-ft Trailer",
    "26-ft Straight Truck /w Lift Gate",
    "Cargo Van",
    "53-ft Reefer /w Team",
    "Reefer Straight box truck /w Pallet Jack",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _day(days: int) -> Column:
    """The ship day moved by some days, as ``MM/dd/yyyy`` text."""
    iso = F.date_add(F.col("l_shipdate").cast("date"), days).cast("string")
    return F.regexp_replace(iso, r"^(\d{4})-(\d{2})-(\d{2})$", "$2/$3/$1")


def _at(day: str, hour: int | Column) -> Column:
    """A day text with a full hour appended."""
    hour = hour if isinstance(hour, Column) else F.lit(hour)
    return F.concat(F.col(day), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem")


def _year_month(base: str) -> Column:
    iso = F.col(base).cast("string")
    return F.concat(F.substring(iso, 3, 2), F.substring(iso, 6, 2))


def _share(value: float, column: str | None = None) -> Column:
    return (F.lit(value) if column is None else F.col(column)).cast("decimal(4,2)")


def _price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


def _repeated(amount: int) -> Column:
    """In every tenth order the first sub-shipment repeats the amount of the first main row."""
    repeats = F.when(F.col("l_linenumber").isin(1, 3), F.lit(amount)).otherwise(F.lit(0))
    return F.when(F.col("l_orderkey") % 10 == 4, repeats)


def _revenue() -> Column:
    return (
        F.when(F.col("l_orderkey") % 10 == 4, _repeated(100))
        .when(F.col("l_quantity") == 1, F.lit(None))
        .when(F.col("l_quantity") == 2, F.lit(0))
        .otherwise(_price() * (_share(1) - _share(0, "l_discount")))
        .cast(MONEY)
    )


def _cost() -> Column:
    rate = _share(0.75) + _share(4) * _share(0, "l_tax")
    return F.coalesce(_repeated(80), F.when(F.col("l_quantity") != 3, _price() * rate)).cast(MONEY)


def _leg_id() -> Column:
    keys = [_text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat(F.lit("S-"), F.concat_ws("-", *keys, _price().cast("string")))


def _load_id() -> Column:
    """One load a month for ten parts; some orders have a load of their own, which their main rows then share."""
    parts = F.floor(F.col("l_partkey") / 10).cast("string")
    month = F.concat(parts, F.lit("-"), _year_month("l_shipdate"))
    return F.when(F.col("l_orderkey") % 10 == 6, F.concat(F.lit("O-"), _text("l_orderkey"))).otherwise(month)


def _main_flag() -> Column:
    return (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") >= 50), F.lit(None))
        .when(F.col("l_linenumber") <= 2, F.lit("YES"))
        .otherwise(F.lit("NO"))
    )


def _shipment_type() -> Column:
    kind = F.col("o_orderkey") % 10
    return (
        F.when(kind <= 5, F.lit("Less Than Truckload"))
        .when(kind <= 7, F.lit("Full Truckload"))
        .when(kind == 8, F.lit("Parcel"))
        .otherwise(F.lit("LTL_CD"))
    )


def _order_status(open_status: Column) -> Column:
    status = F.col("o_orderstatus")
    return (
        F.when(status == "F", F.lit("Complete")).when(status == "P", F.lit("canceled")).otherwise(open_status)
    )


def _pick_site() -> Column:
    return F.concat(F.lit("LOC-"), (F.col("l_partkey") % 20).cast("string"))


def _drop_site() -> Column:
    return F.concat(F.lit("LOC-"), (F.col("l_suppkey") % 20).cast("string"))


def _blank_or(column: str, modulus: int, blanks: dict[int, str | None], value: Column) -> Column:
    rest = F.col(column) % modulus
    out = value
    for remainder, blank in blanks.items():
        out = F.when(rest == remainder, F.lit(blank)).otherwise(out)
    return out


def _arrival_columns() -> dict[str, Column]:
    """The columns that decide when a leg is delivered, all of them of the line item alone."""
    quantity = F.col("l_quantity").cast("int")
    return {
        "pickLocationName": _pick_site(),
        "dropLocationName": _drop_site(),
        "dropWindowFrom": _at("drop_day", 17),
        "dropTimeArrived": _blank_or("l_partkey", 7, {0: "", 1: None}, _at("drop_day", quantity % 24)),
        "dropDateArrived": _blank_or("l_partkey", 14, {0: ""}, F.col("drop_day")),
    }


def _timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their delivery time and date.

    Ranges of it are then filtered before line items are shuffled to their orders.
    """
    lines = _lines(spark, sf_dir)
    arrivals = lines.withColumns({"drop_day": _day(3)}).withColumns(_arrival_columns())
    timed = with_delivery_time(with_event_times(arrivals, ("drop_arrived_ts", "drop_from_ts")))
    return timed.select(*lines.columns, "delivery_ts", F.to_date("delivery_ts").alias("delivery_date"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leg table: one row per line item."""
    return _legs_of(spark, sf_dir, _lines(spark, sf_dir))


def _legs_of(spark: SparkSession, sf_dir: str, lines: DataFrame, *kept: str) -> DataFrame:
    """The legs of line items, with further columns of theirs.

    Orders meet their customers first, so that line items are shuffled once, with nothing but their own columns.
    Nations and regions are few at any scale.
    """
    nation = _table(spark, sf_dir, "nation").join(
        _table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    origin = nation.select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"), F.col("r_name").alias("s_region")
    )
    destination = nation.select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nation"), F.col("r_name").alias("c_region")
    )
    orders = (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(destination), "c_nationkey")
    )
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(origin), "s_nationkey")
        .withColumns({"booked_day": _day(-2), "ship_day": _day(0), "drop_day": _day(3)})
    )
    order = F.concat(F.lit("-"), _text("o_orderkey"))
    line_open = F.when(F.col("l_linestatus") == "O", F.lit("Pending")).otherwise(F.lit("removed"))
    quantity = F.col("l_quantity").cast("int")
    succeeded = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 2), F.lit("Succeeded"))
    pick_city, drop_city = F.col("s_suppkey") % 40, F.col("c_custkey") % 40
    miles = F.abs(F.col("s_nationkey") - F.col("c_nationkey")) * 100 + F.col("l_linenumber")
    arrivals = _arrival_columns()
    columns = {
        "orderCode": F.concat(F.lit("P"), order),
        "warpId": _leg_id(),
        "loadId": _load_id(),
        "orderId": _text("o_orderkey"),
        "shipmentWarpId": F.concat(F.lit("S"), order),
        "clientName": _blank_or("c_custkey", 50, {0: "", 1: None}, F.col("c_name")),
        "carrierName": _blank_or("s_suppkey", 25, {7: None}, F.col("s_name")),
        "carrierSaleRep": F.concat(F.lit("REP-"), (F.col("s_suppkey") % 7).cast("string")),
        "mainShipment": _main_flag(),
        "shipmentType": _shipment_type(),
        "shipmentStatus": _order_status(line_open),
        "accessorialType": F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08), F.lit("TONU")),
        "equipment": F.element_at(
            F.array(*[F.lit(e) for e in EQUIPMENT]), (F.col("l_partkey") % 5 + 1).cast("int")
        ),
        "startMarket": _blank_or("l_partkey", 97, {0: None, 1: ""}, F.col("s_nation")),
        "endMarket": _blank_or("l_partkey", 89, {0: None}, F.col("c_nation")),
        "pickLocationName": arrivals["pickLocationName"],
        "dropLocationName": arrivals["dropLocationName"],
        "pickCity": F.concat(F.lit("CITY-"), pick_city.cast("string")),
        "dropCity": F.concat(F.lit("CITY-"), drop_city.cast("string")),
        "pickState": F.col("s_region"),
        "dropState": F.col("c_region"),
        "pickZipCode": _blank_or("l_partkey", 83, {0: ""}, F.lpad(pick_city.cast("string"), 5, "0")),
        "dropZipCode": F.lpad(drop_city.cast("string"), 5, "0"),
        "pickWindowFrom": _at("ship_day", 8),
        "pickWindowTo": _at("ship_day", 12),
        "pickTimeArrived": _blank_or("l_partkey", 11, {0: None}, _at("ship_day", 6 + quantity % 8)),
        "dropWindowFrom": arrivals["dropWindowFrom"],
        "dropWindowTo": _at("drop_day", 20),
        "dropTimeArrived": arrivals["dropTimeArrived"],
        "dropDateArrived": arrivals["dropDateArrived"],
        "loadBookedTime": _blank_or("l_partkey", 3, {0: ""}, _at("booked_day", 9)),
        "pickStatus": succeeded,
        "dropStatus": succeeded,
        "pickupDelayCode": F.when(F.col("l_partkey") % 13 == 0, F.lit("Weather")).otherwise(F.lit("")),
        "deliveryDelayCode": F.when(F.col("l_partkey") % 17 == 0, F.lit("Traffic")).otherwise(F.lit("")),
        "revenueAllocationNumber": _revenue(),
        "costAllocationNumber": _cost(),
        "totalRevenue": _price().cast(MONEY),
        "totalCost": _price().cast(MONEY),
        "shipmentMiles": _blank_or("l_partkey", 61, {0: None}, miles.cast("double")),
    }
    return rows.select(*[expression.alias(name) for name, expression in columns.items()], *kept)


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers: totals as text, without cross-dock handling.

    Header revenue is the revenue of the order's sub-shipments, or of all its
    rows when it has none; header cost is the cost of all its rows.
    """
    sub = F.col("mainShipment") == "NO"
    zero = F.lit(0).cast(MONEY)
    totals = (
        _lines(spark, sf_dir)
        .filter(F.col("l_partkey") % 20 != F.col("l_suppkey") % 20)
        .select("l_orderkey", _main_flag().alias("mainShipment"), _revenue().alias("rev"), _cost().alias("cost"))
        .groupBy("l_orderkey")
        .agg(
            F.count(F.when(sub, 1)).alias("sub_rows"),
            F.sum(F.when(sub, F.coalesce("rev", zero)).otherwise(zero)).alias("sub_rev"),
            F.sum(F.coalesce("rev", zero)).alias("all_rev"),
            F.sum(F.coalesce("cost", zero)).alias("cost"),
        )
    )
    revenue = F.when(F.col("sub_rows") > 0, F.col("sub_rev")).otherwise(F.col("all_rev"))
    return (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.concat(F.lit("P-"), _text("o_orderkey")).alias("code"),
            F.col("c_name").alias("customerName"),
            _order_status(F.lit("Pending")).alias("status"),
            _shipment_type().alias("shipmentType"),
            revenue.cast("decimal(18,2)").cast("string").alias("revenueAllocation"),
            F.col("cost").cast("decimal(18,2)").cast("string").alias("costAllocation"),
            F.substring(_text("o_orderdate"), 1, 10).alias("createdAt"),
        )
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route per load, listing all legs on it."""
    codes = F.sort_array(F.collect_set("code"))  # the few line items of ten parts in a month
    return (
        _lines(spark, sf_dir)
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(_load_id().alias("routeId"), "s_name", _leg_id().alias("code"))
        .groupBy("routeId")
        .agg(F.min("s_name").alias("carrierName"), codes.alias("codes"))
        .select(
            "routeId",
            "carrierName",
            F.to_json("codes").alias("shipmentCodes"),
            F.to_json(F.transform("codes", lambda c: F.substring(c, 3, 100))).alias("shipmentWarpIds"),
        )
    )


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(_text("c_custkey").alias("id"), F.col("c_name").alias("name"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shipment per order; four in five hang off the first of their five."""
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("warpId"),
        F.when(key % 5 != 0, F.concat(F.lit("S-"), (key - key % 5).cast("string"))).alias("parent"),
        F.concat(F.lit("S-"), _text("o_orderkey"), F.lit("-"), _year_month("o_orderdate")).alias("code"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote per order, for its customer."""
    return (
        _table(spark, sf_dir, "orders")
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_name").alias("customer"), F.col("o_totalprice").cast(MONEY).alias("price"))
    )


def crossdock_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per handling leg."""
    return (
        _table(spark, sf_dir, "lineitem")
        .filter(F.col("l_partkey") % 20 == F.col("l_suppkey") % 20)
        .select(_leg_id().alias("shipmentId"), _drop_site().alias("crossdock"))
    )


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "legs": legs,
    "order_headers": order_headers,
    "routes": routes,
    "carriers": carriers,
    "clients": clients,
    "shipments": shipments,
    "quotes": quotes,
    "crossdock_records": crossdock_records,
}


def with_dates(legs: DataFrame) -> DataFrame:
    """Enriched legs, with the delivery date that a stored table is read by."""
    return enrich(legs).withColumn("delivery_date", F.to_date("delivery_ts"))


def enriched_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``with_dates`` of the legs, with the delivery time worked out on line items, before their joins."""
    timed = with_event_times(_legs_of(spark, sf_dir, _timed_lines(spark, sf_dir), "delivery_ts", "delivery_date"))
    names = [name for name in timed.columns if name not in ("delivery_ts", "delivery_date")]
    flagged = with_flags(timed.select(*names, "delivery_ts", "delivery_date"))
    return flagged.select(*[name for name in flagged.columns if name != "delivery_date"], "delivery_date")
