"""Every report as a query over the test tables.

Each entry takes the tables derived from one directory and returns a frame.
``plain`` then gives results the types any engine shares: money as double and
dates as text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import sample
from lanelytics import LegQuery
from lanelytics.functions import service as sv
from lanelytics.functions.labels import lane_label
from lanelytics.operators import dedup, order_stats
from lanelytics.operators.order_states import number_orders, order_states
from lanelytics.operators.predicates import ZIPS, customer_view
from lanelytics.operators.ranks import with_places
from lanelytics.operators.sketches import error_bound, estimates
from lanelytics.plans import (
    breakdowns as bd,
    companions as cp,
    drilldown as dd,
    lanes as ln,
    profit_reports as pr,
    quality as ql,
    service_levels as sl,
    stats as st,
    strategy as sg,
)
from lanelytics.sources.merge import merged
from lanelytics.sources.tables import run_sql

START, END = "1997-01-01", "1998-12-31"
AS_OF = dt.date(1998, 6, 17)
Q = LegQuery(START, END)
MARKET_LANE = bd.market_lane("NATION_15", "NATION_2")
LANE = "NATION_15 → NATION_2"
ZIP_LANE = bd.zip_lane("00001", "00002")
CUSTOMER = "Customer#000000007"
EXCLUDED = ("Customer#000000002", "Customer#000000003")
SOME_CUSTOMERS = tuple(f"Customer#{n:09d}" for n in range(2, 50))
SOME_LANES = tuple(f"NATION_{n} → NATION_2" for n in range(25))
SITES = ("LOC-1", "Loc-1")
EQUIPMENT = sample.EQUIPMENT


class Tables:
    """The freight tables derived from one directory of test tables, as lazy plans.

    ``enriched`` is the folder of a stored copy of the enriched legs, as users have, and
    ``companions`` the folders of stored copies of other tables by name.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, enriched: str | None = None, companions: dict[str, str] | None = None):
        self.spark, self.sf_dir, self.enriched, self.companions = spark, sf_dir, enriched, companions or {}

    def _companion(self, name: str) -> DataFrame:
        if name in self.companions:
            return self.spark.read.parquet(self.companions[name])
        return sample.TABLES[name](self.spark, self.sf_dir)

    @cached_property
    def legs(self) -> DataFrame:
        if self.enriched is not None:
            return self.spark.read.parquet(self.enriched)
        return sample.enriched_legs(self.spark, self.sf_dir)

    @cached_property
    def headers(self) -> DataFrame:
        return self._companion("order_headers")

    @cached_property
    def routes(self) -> DataFrame:
        return self._companion("routes")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in sample.TABLES:
            raise AttributeError(name)
        return self._companion(name)


def _of_type(kind: str, **more) -> LegQuery:
    return LegQuery(START, END, shipment_type=kind, **more)


LTL, FTL, PARCEL = "Less Than Truckload", "Full Truckload", "Parcel"


def _peers(t: Tables) -> DataFrame:
    lanes = ln.lane_diagnostics(t.legs, Q, min_orders=1, only_negative=False)
    return ln.similar_mileage(t.legs, Q, ln.target_miles(lanes, LANE))


def _kept(lanes: DataFrame) -> DataFrame:
    """The rows of a report by lane, which do not grow with the legs: places evaluate them three times, the legs once."""
    return lanes.localCheckpoint()


def _ltl(t: Tables) -> DataFrame:
    return sg.completed_of_type(t.legs)


def _smart(t: Tables, *names: str, **options) -> DataFrame:
    return sg.smart_orders(_ltl(t), **options).select("orderCode", *names)


def _six_digits(statistics: DataFrame) -> DataFrame:
    """Statistics that depend on the order of summation, to six digits."""
    return statistics.withColumn("value", F.round("value", 6))


def _states(t: Tables) -> DataFrame:
    return order_states(t.legs, number_orders(t.legs))


def _merged_by_day(t: Tables) -> DataFrame:
    """Legs of some orders two days later, of others withdrawn, and late legs."""
    number = F.col("orderId").cast("bigint")
    moved = t.legs.filter(number % 7 == 0).withColumn("delivery_ts", F.col("delivery_ts") + F.expr("INTERVAL 2 DAYS"))
    late = t.legs.filter(number % 13 == 1).withColumn("warpId", F.concat(F.lit("late "), "warpId"))
    changed = moved.unionByName(late).withColumn("delivery_date", F.to_date("delivery_ts"))
    rows = merged(t.legs, changed, t.legs.filter(number % 11 == 3))
    return rows.groupBy(F.col("delivery_date").alias("day")).agg(
        F.count(F.lit(1)).alias("legs"), F.sum("counted_revenue").alias("revenue")
    )


def _with_gaps(t: Tables) -> DataFrame:
    """Legs of some months and weeks only."""
    day = F.col("delivery_ts")
    return t.legs.filter((F.month(day) % 4 != 2) & (F.dayofmonth(day) <= 15) | (F.dayofmonth(day) == 29))


def _estimated(t: Tables) -> DataFrame:
    """Per year, exact distinct values, and whether the estimates from the sketches of its days are within bound."""
    sketches = ql.lane_sketches(t.legs).withColumn("year", F.year("delivery_date"))
    names = ("city_lanes", "market_lanes", "legs")
    estimated = estimates(sketches, names, ["year"]).withColumnsRenamed({n: f"estimated_{n}" for n in names})
    values = {
        "city_lanes": lane_label("pickCity", "dropCity"), "market_lanes": lane_label("startMarket", "endMarket"), "legs": F.col("warpId"),
    }
    exact = None
    for name, value in values.items():
        distinct = t.legs.select(F.year("delivery_ts").alias("year"), value.alias("v")).distinct()
        counted = distinct.groupBy("year").agg(F.count("v").alias(name))
        exact = counted if exact is None else exact.join(counted, "year")
    near = lambda name: F.abs(F.col(f"estimated_{name}") - F.col(name)) <= F.ceil(F.col(name) * error_bound())
    return exact.join(estimated, "year").select("year", *names, *[near(n).alias(f"{n}_within_bound") for n in names])


def _spoiled_headers(t: Tables) -> DataFrame:
    """Order headers of which some are missing, without an amount or hold text that is none."""
    number = F.substring("code", 3, 20).cast("bigint")

    def spoiled(column: str, shift: int):
        rest = (number + shift) % 9
        text = F.when(rest == 0, "n/a").when(rest == 1, " ").when(rest == 2, "1,234.50").when(rest == 3, F.lit(None))
        return text.when(rest == 4, F.concat(F.lit(" "), F.col(column))).otherwise(F.col(column))

    amounts = {"revenueAllocation": spoiled("revenueAllocation", 0), "costAllocation": spoiled("costAllocation", 4)}
    return t.headers.filter(number % 11 != 5).withColumns(amounts)


def _since(t: Tables) -> DataFrame:
    return ql.delivered_since(t.legs, "1997-01-01")


LANES: dict[str, Callable[[Tables], DataFrame]] = {
    "lane_profit": lambda t: ln.lane_profit(t.legs, Q),
    "lane_profit_ftl": lambda t: ln.lane_profit(t.legs, _of_type(FTL)),
    "lane_profit_ltl": lambda t: ln.lane_profit(t.legs, _of_type(LTL)),
    "lane_profit_parcel": lambda t: ln.lane_profit(t.legs, _of_type(PARCEL)),
    "lane_profit_chosen": lambda t: ln.lane_profit(
        t.legs,
        LegQuery(START, END, customers=SOME_CUSTOMERS, lanes=SOME_LANES),
    ),
    "lane_profit_whole_end_day": lambda t: ln.lane_profit(t.legs, LegQuery(START, END, inclusive_end=True)),
    "lane_profit_last_days": lambda t: ln.lane_profit(t.legs, LegQuery.last_days(AS_OF, 30)),
    "lane_profit_headline": lambda t: ln.headline(ln.lane_profit(t.legs, Q)),
    "lane_allocation": lambda t: ln.lane_allocation(t.legs),
    "lane_allocation_with_na": lambda t: ln.lane_allocation(t.legs, known_only=False),
    "market_profit": lambda t: ln.market_profit(t.legs, Q),
    "market_profit_excluding": lambda t: ln.market_profit(
        t.legs, LegQuery(START, END, exclude_customers=EXCLUDED)
    ),
    "market_profit_without_crossdock": lambda t: ln.market_profit(
        t.legs, LegQuery(START, END, include_crossdock=False)
    ),
    "market_profit_headline": lambda t: ln.headline(ln.market_profit(t.legs, Q)),
    "lane_diagnostics": lambda t: ln.lane_diagnostics(t.legs, _of_type(LTL)),
    "lane_diagnostics_all": lambda t: ln.lane_diagnostics(t.legs, Q, min_orders=1, only_negative=False),
    "lane_diagnostics_excluding": lambda t: ln.lane_diagnostics(
        t.legs, LegQuery(START, END, exclude_customers=EXCLUDED)
    ),
    "lane_diagnostics_headline": lambda t: ln.headline(ln.lane_diagnostics(t.legs, Q)),
    "lanes_named_na": lambda t: ln.lanes_named_na(ln.lane_diagnostics(t.legs, Q)),
    "zip_diagnostics": lambda t: ln.zip_diagnostics(t.legs, Q),
    "zip_diagnostics_all": lambda t: ln.zip_diagnostics(t.legs, _of_type(LTL), min_orders=1, only_negative=False),
    "zip_diagnostics_headline": lambda t: ln.headline(ln.zip_diagnostics(t.legs, Q)),
    "similar_mileage": _peers,
    "similar_mileage_tagged": lambda t: ln.tagged_peers(ln.similar_mileage(t.legs, Q, 900.0), LANE),
    "peer_comparison": lambda t: ln.peer_comparison(_peers(t), LANE),
    "lane_customers": lambda t: bd.lane_customers(t.legs, Q, MARKET_LANE),
    "zip_customers": lambda t: bd.lane_customers(t.legs, Q, ZIP_LANE),
    "lane_carriers": lambda t: bd.lane_carriers(t.legs, Q, MARKET_LANE),
    "zip_carriers": lambda t: bd.lane_carriers(t.legs, Q, ZIP_LANE),
    "lane_carrier_extremes": lambda t: bd.carrier_extremes(bd.lane_carriers(t.legs, Q, MARKET_LANE)),
    "zip_carrier_extremes": lambda t: bd.carrier_extremes(bd.lane_carriers(t.legs, Q, ZIP_LANE)),
    "lane_order_details": lambda t: bd.order_details(t.legs, Q, MARKET_LANE),
    "zip_order_details": lambda t: bd.order_details(t.legs, Q, ZIP_LANE),
    "drill_headline_customer": lambda t: dd.drill_headline(t.legs, Q, customer=CUSTOMER),
    "drill_headline_lane": lambda t: dd.drill_headline(t.legs, _of_type(LTL), lane=LANE),
    "drill_headline_unsplittable": lambda t: dd.drill_headline(t.legs, Q, lane="NATION_15"),
    "drill_detail_customer": lambda t: dd.drill_detail(t.legs, Q, customer=CUSTOMER),
    "drill_detail_lane": lambda t: dd.drill_detail(t.legs, Q, lane=LANE),
    "drill_detail_lane_short": lambda t: dd.drill_detail(t.legs, Q, lane=LANE, limit=5),
    "drill_detail_whole": lambda t: dd.drill_detail(t.legs, Q),
    "drill_detail_in_order": lambda t: with_places(dd.drill_detail(t.legs, Q, lane=LANE), dd.DETAIL_ORDER),
    "drill_detail_parcel_whole": lambda t: dd.drill_detail(t.legs, _of_type(PARCEL)),
    "drill_detail_totals": lambda t: dd.detail_totals(dd.drill_detail(t.legs, Q, lane=LANE)),
    "lane_profit_in_order": lambda t: with_places(ln.lane_profit(t.legs, Q), ln.BEST_FIRST),
    "similar_mileage_in_order": lambda t: with_places(_kept(ln.similar_mileage(t.legs, Q, 900.0)), ln.WORST_PEER_FIRST),
    "similar_mileage_tagged_in_order": lambda t: with_places(
        _kept(ln.tagged_peers(ln.similar_mileage(t.legs, Q, 900.0), LANE)), ln.SELECTED_FIRST
    ),
    "lane_profit_from_states": lambda t: ln.lane_profit_of_range(_states(t), Q),
    "lane_profit_from_states_days": lambda t: ln.lane_profit_of_range(_states(t), LegQuery.last_days(AS_OF, 30)),
    "lane_profit_from_states_ltl": lambda t: ln.lane_profit_of_range(_states(t), _of_type(LTL)),
    "market_profit_from_states": lambda t: ln.market_profit_of_range(_states(t), Q),
    "customer_list": lambda t: dd.customer_list(t.legs),
    "customer_list_short": lambda t: dd.customer_list(t.legs, limit=20),
    "lane_list": lambda t: dd.lane_list(t.legs),
    "lane_list_of_customer": lambda t: dd.lane_list(t.legs, customer=CUSTOMER),
    "lane_profit_sql": lambda t: run_sql(
        t.spark,
        "SELECT lane, count(*) AS legs, sum(counted_revenue - counted_cost) AS profit FROM {legs} "
        "WHERE shipmentType = :kind AND lane IS NOT NULL GROUP BY lane",
        {"kind": FTL},
        legs=t.legs,
    ),
}

STRATEGIES: dict[str, Callable[[Tables], DataFrame]] = {
    "order_metrics": lambda t: sg.order_metrics(_ltl(t)),
    "smart_revenue": lambda t: _smart(t, "revenue_rule", "smart_revenue"),
    "smart_revenue_older": lambda t: _smart(t, "revenue_rule", "smart_revenue", variant="main"),
    "smart_cost": lambda t: _smart(t, "cost_rule", "smart_cost"),
    "smart_cost_duplicate_test": lambda t: _smart(t, "cost_rule", "smart_cost", duplicate_test=True),
    "smart_same_market": lambda t: sg.smart_same_market(_ltl(t), ("NATION_1", "NATION_2", "NATION_3")),
    "smart_same_market_all": lambda t: sg.smart_same_market(_ltl(t)),
    "profit_by_type": lambda t: sg.profit_by_type(t.legs),
    "hybrid_orders": lambda t: sg.hybrid_orders(_ltl(t)),
    "revenue_patterns": lambda t: sg.pattern_shares(_ltl(t)),
    "ftl_structures": lambda t: sg.structure_counts(t.legs),
    "strategy_match": lambda t: sg.strategy_match(
        sg.smart_orders(_ltl(t), duplicate_test=True, lanes=False), t.headers
    ),
    "header_coverage": lambda t: sg.header_coverage(sg.order_metrics(_ltl(t), lanes=False), _spoiled_headers(t)),
    "source_reconciliation": lambda t: sg.reconcile(_ltl(t), t.headers),
    "cross_validation": lambda t: sg.cross_validation(t.legs, t.headers),
    "order_costs": lambda t: sg.order_costs(_ltl(t)),
    "lane_costs": lambda t: sg.lane_costs(_ltl(t)),
    "tonu_orders": lambda t: sg.tonu_orders(t.legs),
    "canceled_recognition": lambda t: sg.canceled_recognition(t.legs),
    "canceled_with_handling": lambda t: sg.canceled_with_handling(t.legs).select(
        "orderCode", "warpId", "shipmentStatus"
    ),
}

SERVICE: dict[str, Callable[[Tables], DataFrame]] = {
    "carrier_otp": lambda t: sl.carrier_on_time(t.legs),
    "carrier_otp_quarter": lambda t: sl.carrier_on_time(
        t.legs, carrier="Supplier#000000003", start="1997-10-01", end="1998-01-01"
    ),
    "carrier_otd": lambda t: sl.carrier_on_time(t.legs, "drop"),
    "customer_otd": lambda t: sl.customer_on_time(t.legs),
    "customer_otp": lambda t: sl.customer_on_time(t.legs, side="pick"),
    "customer_otd_week": lambda t: sl.customer_on_time(t.legs, as_of=AS_OF),
    "customer_otd_pivot": lambda t: sl.customer_on_time_pivot(t.legs, EQUIPMENT),
    "site_otd": lambda t: sl.site_on_time(t.legs, SITES),
    "pickup_dedup": lambda t: sl.carrier_stops(t.legs, "pick").select("warpId", "loadId", "pickTimeArrived"),
    "keep_flags": lambda t: dedup.with_keep_flags(t.legs).select("warpId", "keep_for_pickup", "keep_for_delivery"),
    "order_row_counts": lambda t: order_stats.with_order_counts(t.legs).select(
        "warpId", "order_rows", "order_main_rows", "order_sub_rows"
    ),
    "carrier_shipment_counts": lambda t: sl.carrier_shipment_counts(t.legs),
    "rows_for_customer_report": lambda t: order_stats.rows_to_use(t.legs, "customer").select("warpId"),
    "rows_for_carrier_report": lambda t: order_stats.rows_to_use(t.legs, "carrier").select("warpId"),
    "bookings": lambda t: sl.bookings(t.legs),
    "bookings_of_rep": lambda t: sl.bookings(t.legs, "REP-3", "1997-03-14"),
    "status_rules": lambda t: sl.status_counts(
        t.legs,
        {
            "standard": sv.on_time_status("pick"),
            "by_nine": sv.status_by_clock("pick", 9),
            "within_two_hours": sv.status_by_hours("pick", 2),
            "half_hour_grace": sv.status_by_grace("drop", 30),
        },
    ),
    "pickup_delay_reasons": lambda t: sl.delay_reasons(t.legs, "pick"),
    "delivery_delay_reasons": lambda t: sl.delay_reasons(t.legs, "drop"),
    "equipment_mix": lambda t: sl.equipment_mix(t.legs),
    "service_against_targets": lambda t: sl.service_against_targets(t.legs),
}

COMPANIONS: dict[str, Callable[[Tables], DataFrame]] = {
    "customer_profit_from_headers": lambda t: pr.customer_profit_from_headers(t.headers),
    "customer_profit_from_headers_month": lambda t: pr.customer_profit_from_headers(t.headers, as_of=AS_OF),
    "customer_profit_from_legs": lambda t: pr.customer_profit_from_legs(t.legs),
    "customer_profit_from_legs_one": lambda t: pr.customer_profit_from_legs(t.legs, CUSTOMER),
    "lane_profit_from_headers": lambda t: pr.lane_profit_from_headers(t.legs, t.headers, AS_OF, limit=20),
    "lane_profit_from_headers_whole": lambda t: pr.lane_profit_from_headers(t.legs, t.headers),
    "lane_profit_from_headers_once": lambda t: pr.lane_profit_from_headers(t.legs, t.headers, once_per_order=True),
    "lane_profit_from_legs": lambda t: pr.lane_profit_from_legs(t.legs, AS_OF, limit=20),
    "lane_profit_from_legs_whole": lambda t: pr.lane_profit_from_legs(t.legs),
    "main_row_margins": lambda t: pr.leg_margins(t.legs.filter(customer_view())).select("warpId", "profit", "margin"),
    "orders_with_main_legs": lambda t: cp.orders_with_main_legs(t.headers, t.legs),
    "legs_with_routes": lambda t: cp.legs_with_routes(t.legs, t.routes).select("warpId", "route_carrier"),
    "route_agreement": lambda t: cp.route_agreement(t.legs, t.routes),
    "carrier_directory": lambda t: cp.carrier_directory(t.legs, t.carriers),
    "client_directory": lambda t: cp.client_directory(t.legs, t.clients),
    "client_quotes": lambda t: cp.client_quotes(t.legs, t.quotes),
    "handling_by_site": lambda t: cp.handling_by_site(t.legs, t.crossdock_records),
    "legs_on_routes": lambda t: cp.legs_on_routes(t.legs, t.routes),
    "shipment_links": lambda t: cp.shipment_links(t.legs, t.shipments),
}

QUALITY: dict[str, Callable[[Tables], DataFrame]] = {
    "merged_legs": _merged_by_day,
    "delivery_days": lambda t: t.legs.groupBy(F.to_date("delivery_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("legs")
    ),
    "zip_lane_labels": lambda t: t.legs.groupBy(lane_label(*ZIPS).alias("lane")).agg(F.count(F.lit(1)).alias("legs")),
    "allocation_profile": lambda t: ql.allocation_profile(t.legs),
    "multi_leg_allocations": lambda t: ql.multi_leg_allocations(t.legs, limit=20),
    "multi_leg_allocations_whole": lambda t: ql.multi_leg_allocations(t.legs),
    "allocation_frequency": lambda t: ql.allocation_frequency(t.legs),
    "allocated_amounts": lambda t: ql.allocated_amounts(t.legs),
    "allocated_amounts_sample": lambda t: ql.allocated_amounts(t.legs, sample=5),
    "allocation_stats": lambda t: ql.allocation_stats(t.legs),
    "lane_field_coverage": lambda t: ql.field_coverage(_since(t)),
    "lane_field_coverage_by_flag": lambda t: ql.field_coverage(_since(t), by_main_flag=True),
    "time_field_coverage": lambda t: ql.field_coverage(t.legs, ql.TIME_FIELDS, by_main_flag=True),
    "distinct_lanes": lambda t: ql.distinct_lanes(_since(t)),
    "top_lanes": lambda t: ql.top_lanes(_since(t), limit=15),
    "top_lanes_whole": lambda t: ql.top_lanes(_since(t)),
    "completeness": lambda t: ql.completeness(t.legs),
    "sanity_checks": lambda t: ql.sanity_checks(t.legs),
    "margin_summary": lambda t: _six_digits(st.margin_summary(t.legs.filter(customer_view()))),
    "margin_distribution": lambda t: _six_digits(st.margin_distribution(t.legs)),
    "weekly_change": lambda t: st.weekly_change(t.legs, every_period=False),
    "weekly_change_by_type": lambda t: st.weekly_change(t.legs, ("shipmentType",), every_period=False),
    "weekly_change_of_every_week": lambda t: st.weekly_change(_with_gaps(t), ("shipmentType",)),
    "monthly_change": lambda t: st.monthly_change(t.legs, every_period=False),
    "monthly_change_of_every_month": lambda t: st.monthly_change(_with_gaps(t), ("carrierSaleRep",)),
    "rolling_profit": lambda t: st.rolling_profit(t.legs.filter(F.col("lane").isNotNull()), every_period=False),
    "rolling_profit_of_every_month": lambda t: st.rolling_profit(_with_gaps(t)),
    "distinct_lanes_estimated": _estimated,
}

REPORTS = {**LANES, **STRATEGIES, **SERVICE, **COMPANIONS, **QUALITY}

_SHARED_TYPES = {T.DecimalType: "double", T.DateType: "string", T.IntegerType: "bigint"}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double, dates as text and integers as long."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = type(field.dataType)
        if kind in _SHARED_TYPES:
            column = column.cast(_SHARED_TYPES[kind])
        out.append(column.alias(field.name))
    return df.select(*out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(report: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plain(report(Tables(spark, sf_dir)))

    return {name: bound(report) for name, report in REPORTS.items()}
