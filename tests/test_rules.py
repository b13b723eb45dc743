"""Rules for one leg: times, counted money, labels, service."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanelytics import LegQuery, enrich
from lanelytics.functions import labels, service, times
from lanelytics.functions.money import allocated, header_amount, percent
from lanelytics.operators import predicates as pd_
from lanelytics.operators.order_stats import counted_shipments, rows_to_use
from lanelytics.plans import breakdowns, drilldown, lanes, quality, service_levels
from lanelytics.sources.schema import normalize_status

T1 = dt.datetime(2024, 5, 1, 10)


def delivered(make_legs, *rows, **shared):
    return [r.delivery_ts for r in make_legs(*rows, **shared).orderBy("warpId").collect()]


def test_delivery_time_takes_the_first_source_present(make_legs):
    base = {"dropWindowFrom": "05/01/2024 10:00:00", "pickLocationName": "A", "dropLocationName": "B"}
    got = delivered(
        make_legs,
        {"dropTimeArrived": "05/02/2024 08:30:00", "dropDateArrived": "05/03/2024"},
        {"dropTimeArrived": "", "dropDateArrived": "05/03/2024"},
        {"dropTimeArrived": None, "dropDateArrived": ""},
        {"dropTimeArrived": "05/02/2024 08:30:00", "dropLocationName": "A"},
        {"dropTimeArrived": "05/02/2024 08:30:00", "pickLocationName": None, "dropLocationName": None},
        {"dropTimeArrived": "no time", "dropDateArrived": "05/03/2024"},
        **base,
    )
    assert got == [
        dt.datetime(2024, 5, 2, 8, 30),
        dt.datetime(2024, 5, 3),
        T1,
        T1,
        dt.datetime(2024, 5, 2, 8, 30),
        None,
    ]


@pytest.mark.parametrize(
    ("text", "strict", "lenient"),
    [
        ("01/02/2024 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("01/02/2024", None, dt.datetime(2024, 1, 2)),
        ("2024-01-02 03:04:05", None, None),
        ("01/02/2024 03:04:05 PM", None, None),
        ("02/30/2024 00:00:00", None, None),
        ("13/01/2024 00:00:00", None, None),
        ("01/02/2024 24:00:00", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_event_times(spark, text, strict, lenient):
    frame = spark.createDataFrame([(text,)], "t string")
    (row,) = frame.select(times.event_time(F.col("t")), times.event_time(F.col("t"), lenient=True)).collect()
    assert tuple(row) == (strict, lenient)


def test_event_times_ignore_the_session_zone(spark):
    frame = spark.createDataFrame([("03/10/2024 02:30:00",)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        (row,) = frame.select(times.event_time(F.col("t")).cast("string").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.t == "2024-03-10 02:30:00"


def test_range_ends_at_midnight_unless_asked(make_legs):
    rows = [{"dropWindowFrom": f"05/02/2024 00:00:0{s}"} for s in (0, 1)]
    frame = make_legs(*rows, shipmentStatus="Complete")
    assert pd_.matching(frame, LegQuery("2024-05-01", "2024-05-02")).count() == 1
    assert pd_.matching(frame, LegQuery("2024-05-01", "2024-05-02", inclusive_end=True)).count() == 2


def test_default_ranges_reach_back_from_a_day():
    query = LegQuery.last_days(dt.date(2024, 5, 31), 30, shipment_type="Parcel")
    assert (query.start, query.end, query.shipment_type) == ("2024-05-01", "2024-05-31", "Parcel")


def test_counted_money(make_legs):
    handling = {"pickLocationName": "A", "dropLocationName": "A"}
    transport = {"pickLocationName": "A", "dropLocationName": "B"}
    frame = make_legs(
        {"shipmentStatus": "Complete", **transport},
        {"shipmentStatus": "canceled", **transport},
        {"shipmentStatus": "canceled", **handling},
        {"shipmentStatus": "canceled", "accessorialType": "TONU", **transport},
        {"shipmentStatus": "Pending", "accessorialType": "TONU", **transport},
        {"shipmentStatus": "Pending", **handling},
        {"shipmentStatus": None},
        {"shipmentStatus": "Complete", "revenueAllocationNumber": None},
        revenueAllocationNumber=10,
    )
    assert [int(r.counted_revenue) for r in frame.orderBy("warpId").collect()] == [10, 0, 10, 10, 10, 0, 0, 0]


def test_unknown_values_do_not_pass_exclusions(make_legs):
    frame = make_legs(
        {"clientName": "X"}, {"clientName": None}, {"clientName": "Y"}, shipmentStatus="Complete",
        dropWindowFrom="05/01/2024 10:00:00",
    )
    query = LegQuery("2024-05-01", "2024-05-02", exclude_customers=("X",))
    assert [r.clientName for r in pd_.matching(frame, query).collect()] == ["Y"]
    assert frame.filter(pd_.not_removed()).count() == 3
    assert make_legs({"shipmentStatus": None}).filter(pd_.not_removed()).count() == 0


def test_crossdock_filter_keeps_unknown_places(make_legs):
    frame = make_legs(
        {"pickLocationName": "A", "dropLocationName": "A"}, {"pickLocationName": None, "dropLocationName": "A"},
        dropWindowFrom="05/01/2024 10:00:00",
    )
    query = LegQuery("2024-05-01", "2024-05-02", include_crossdock=False)
    assert [r.pickLocationName for r in pd_.matching(frame, query).collect()] == [None]


def test_status_spelling_is_normalized(spark):
    frame = spark.createDataFrame([("Removed",), ("CANCELED",), ("odd",), (None,)], "shipmentStatus string")
    assert [r[0] for r in normalize_status(frame).collect()] == ["removed", "canceled", "odd", None]


def test_rates_without_a_denominator_are_zero(spark):
    frame = spark.createDataFrame([(5.0, 0.0), (5.0, -1.0), (5.0, 10.0)], "a double, b double")
    assert [r[0] for r in frame.select(percent(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 50.0]


def test_allocated_amounts_are_rounded_to_the_cent(spark):
    frame = spark.sql("SELECT 100.0050::decimal(18,4) t, 0.5::decimal(18,4) s UNION ALL SELECT 7.125, NULL")
    assert [str(r[0]) for r in frame.select(allocated(F.col("t"), F.col("s"))).collect()] == ["50.00", "7.13"]


def test_header_amounts_tolerate_bad_text(spark):
    frame = spark.createDataFrame([("12.345",), ("n/a",), (None,)], "t string")
    assert [r[0] and str(r[0]) for r in frame.select(header_amount(F.col("t"))).collect()] == ["12.35", None, None]


def test_lane_text():
    assert labels.split_lane("A → B") == ("A", "B")
    assert labels.split_lane("A") is None
    assert labels.split_lane("A → B → C") is None
    assert labels.split_lane(None) is None


def test_lane_label_needs_both_ends(make_legs):
    frame = make_legs({"startMarket": "A", "endMarket": None}, {"startMarket": "A", "endMarket": "B"})
    assert [r.lane for r in frame.orderBy("warpId").collect()] == [None, "A → B"]


def test_equipment(make_legs):
    names = ["53-ft Trailer", "53-ft Reefer /w Team", "Cargo Van /w Lift Gate", "", None]
    rows = service_levels.equipment_mix(make_legs(*[{"equipment": n} for n in names])).collect()
    got = {(r.equipment_class, r.has_lift_gate, r.has_team): r.legs for r in rows}
    assert got == {
        ("dry", False, False): 1, ("reefer", False, True): 1, ("dry", True, False): 1, (None, False, False): 2
    }


def test_shipment_numbers(spark):
    frame = spark.createDataFrame([("S-12",), ("12",), ("P-12",), ("S-12-2401",), (None,)], "c string")
    got = [r[0] for r in frame.select(labels.shipment_number(F.col("c"))).collect()]
    assert got == ["12", "12", None, None, None]
    assert frame.select(labels.shipment_code(F.col("c"))).first()[0] == "S-12"


def test_service_rules(make_legs):
    frame = make_legs(
        {"pickTimeArrived": "05/01/2024 11:59:59"},
        {"pickTimeArrived": "05/01/2024 12:00:00"},
        {"pickTimeArrived": None},
        pickWindowFrom="05/01/2024 08:00:00",
        pickWindowTo="05/01/2024 12:00:00",
        pickupDelayCode="",
    ).orderBy("warpId")
    late, good = service.LATE, service.ON_TIME
    rules = [
        service.on_time_status("pick"),
        service.status_by_clock("pick", 9),
        service.status_by_hours("pick", 4),
        service.status_by_grace("pick", 0),
        service.delay_code("pick", service.on_time_status("pick")),
    ]
    got = [tuple(r) for r in frame.select(*rules).collect()]
    assert got == [
        (good, late, good, good, ""),
        (late, late, good, good, "Carrier Failure"),
        (late, None, None, None, "Carrier Failure"),
    ]


def test_previous_week_and_month(spark):
    days = ["2024-05-05", "2024-05-06", "2024-05-12", "2024-05-13", "2024-04-30", "2024-03-31"]
    frame = spark.createDataFrame([(d,) for d in days], "d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    as_of = dt.date(2024, 5, 15)
    week = [r.d for r in frame.filter(times.in_previous_week(F.col("t"), as_of)).collect()]
    month = [r.d for r in frame.filter(times.in_previous_month(F.col("t"), as_of)).collect()]
    assert week == ["2024-05-06", "2024-05-12"]
    assert month == ["2024-04-30"]


def test_detail_lists_parcel_main_rows_and_no_crossdock_type(make_legs):
    kinds = [("Full Truckload", "NO"), ("Less Than Truckload", None), ("Parcel", "YES"), ("Parcel", "NO"), ("LTL_CD", "YES")]
    frame = make_legs(
        *[{"shipmentType": k, "mainShipment": m} for k, m in kinds],
        shipmentStatus="Pending", dropWindowFrom="05/01/2024 10:00:00", clientName="C",
    )
    query = LegQuery("2024-05-01", "2024-05-02")
    assert drilldown.drill_detail(frame, query, customer="C").count() == 3
    assert drilldown.drill_detail(frame, query, customer="C", limit=2).count() == 2
    assert drilldown.drill_headline(frame, query, customer="C").first().completed_orders == 0


def test_detail_order(make_legs):
    rows = [("P-2", "NO", "b"), ("P-1", "NO", "c"), ("P-1", None, "d"), ("P-1", "YES", "e"), ("P-2", "NO", "a")]
    frame = make_legs(
        *[{"orderCode": o, "mainShipment": m, "warpId": w} for o, m, w in rows],
        shipmentStatus="Complete", shipmentType="Full Truckload", dropWindowFrom="05/01/2024 10:00:00",
    )
    detail = drilldown.drill_detail(frame, LegQuery("2024-05-01", "2024-05-02"))
    assert [r["Warp ID"] for r in detail.collect()] == ["e", "c", "d", "a", "b"]


def test_main_rows_without_miles_count_as_zero(make_legs):
    frame = make_legs(
        {"mainShipment": "YES", "shipmentMiles": 101.0},
        {"mainShipment": "YES", "shipmentMiles": None},
        {"mainShipment": "NO", "shipmentMiles": 900.0},
        shipmentStatus="Complete", startMarket="A", endMarket="NAB", dropWindowFrom="05/01/2024 10:00:00",
    )
    query = LegQuery("2024-05-01", "2024-05-02")
    result = lanes.lane_diagnostics(frame, query, min_orders=1, only_negative=False)
    assert result.first().avg_miles == 51.0
    assert lanes.lanes_named_na(result).first().na_lanes == 1
    assert lanes.similar_mileage(frame, query, 63.0, min_orders=1).count() == 1
    assert lanes.similar_mileage(frame, query, 64.0, min_orders=1).count() == 0


def test_carrier_counting_rule(make_legs):
    base = {"shipmentType": "Less Than Truckload", "carrierName": "C"}
    full = {"shipmentType": "Full Truckload", "carrierName": "C", "loadId": "L-1"}
    frame = make_legs(
        {"orderCode": "P-1", "mainShipment": "YES", **base},
        {"orderCode": "P-1", "mainShipment": "NO", **base},
        {"orderCode": "P-2", "mainShipment": "YES", **base},
        {"orderCode": "P-2", "mainShipment": "NO", **{**base, "carrierName": "D"}},
        {"orderCode": "P-3", "mainShipment": "YES", **full},
        {"orderCode": "P-3", "mainShipment": "YES", **full},
        {"orderCode": "P-3", "mainShipment": "NO", **full},
        {"orderCode": "P-4", "mainShipment": "YES", **full},
        {"orderCode": "P-4", "mainShipment": "YES", **{**full, "loadId": "L-2"}},
        {"orderCode": "P-4", "mainShipment": "NO", **full},
    )
    assert sorted(r.warpId for r in counted_shipments(frame, "C").collect()) == ["S-1", "S-2"]
    assert sorted(r.warpId for r in counted_shipments(frame).collect()) == ["S-1", "S-2", "S-3"]
    assert sorted(r.warpId for r in rows_to_use(frame, "carrier").collect()) == [
        "S-1", "S-3", "S-4", "S-5", "S-7", "S-8", "S-9",
    ]
    assert rows_to_use(frame, "customer").count() == 6
    with pytest.raises(ValueError, match="report"):
        rows_to_use(frame, "both")


def test_extremes_break_ties_by_listing_order(spark):
    carriers = spark.createDataFrame(
        [("A", 3, 5.0, 1.0), ("B", 3, -5.0, 1.0), ("C", 1, -5.0, 2.0)],
        "carrier string, orders_with_carrier long, total_profit double, avg_profit_per_shipment double",
    )
    row = breakdowns.carrier_extremes(carriers).first()
    assert (row.most_used, row.worst_profit_carrier, row.worst_avg_carrier) == ("B", "B", "B")


def test_coverage_of_nothing_has_no_percentages(make_legs):
    row = quality.field_coverage(make_legs({"pickCity": "x"}).filter("false")).first()
    assert (row.total_rows, row.pct_pickCity) == (0, None)


def test_enriching_twice_changes_nothing(make_legs):
    frame = make_legs({"shipmentStatus": "Complete", "revenueAllocationNumber": 3})
    assert enrich(frame).collect() == frame.collect()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("01/05/2025 08:05:00", "2025-01-05 08:05:00"),
        ("1/5/2025 8:05:00", "2025-01-05 08:05:00"),
        ("1/5/2025 8:05", None),
        ("01/05/2025 08:05:0 ", None),
        (" 1/05/2025 08:05:00", None),
        ("01/05/2025", None),
        ("13/05/2025 08:05:00", None),
        ("", None),
        (None, None),
    ],
)
def test_event_times_may_have_one_digit_parts(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(times.event_time(F.col("t")).cast("string").alias("at")).first().at
    assert got == expected


def test_blanks_in_a_date_are_no_date(spark):
    frame = spark.createDataFrame([("01/5 /2025",), ("1/5/2025",), ("01/05/2025",)], "t string")
    got = [r.at for r in frame.select(times.event_date(F.col("t")).cast("string").alias("at")).collect()]
    assert got == [None, "2025-01-05 00:00:00", "2025-01-05 00:00:00"]


def test_full_and_other_texts_are_read_alike(spark):
    """Text in its full length is read by position, with the results of matching its groups."""
    odd = "09/: -+.TZ\n٣"
    full = "01/02/1997 10:00:05"
    texts = [full[:n] + a + b + full[n + 2 :] for n in range(len(full)) for a in odd for b in odd]
    frame = spark.createDataFrame([(text,) for text in [*texts, f"{full}\n", "", None]], "t string")
    matched = F.regexp_replace("t", *times.EVENT_TIME).try_cast("timestamp_ntz")
    same = matched.eqNullSafe(times.event_time(F.col("t")))
    got = frame.select(F.count(matched).alias("known"), F.count_if(~same).alias("other")).first()
    assert got.known > 20 and got.other == 0
