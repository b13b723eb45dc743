"""Orders whose right result is known."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lanelytics import LegQuery
from lanelytics.plans import lanes, strategy

LTL = {"shipmentType": "Less Than Truckload", "shipmentStatus": "Complete"}
FTL = {"shipmentType": "Full Truckload", "shipmentStatus": "Complete"}


def leg(main, revenue, cost, handling=False, **more):
    return {
        "mainShipment": main,
        "revenueAllocationNumber": revenue,
        "costAllocationNumber": cost,
        "pickLocationName": "A",
        "dropLocationName": "A" if handling else "B",
        **more,
    }


def order(frame, **options):
    (row,) = strategy.smart_orders(frame, **options).collect()
    return row


def test_header_repeats_its_legs(make_legs):
    row = order(make_legs(leg("YES", 85, 0), leg("NO", 42, 57), leg("NO", 43, 58), **LTL))
    assert (row.smart_revenue, row.revenue_rule, row.all_rev, row.all_cost) == (85, 3, 170, 115)


def test_revenue_on_legs_only(make_legs):
    row = order(
        make_legs(
            leg("YES", 0, 0),
            leg("NO", "133.14", "65.13"),
            leg("NO", 458, "413.33"),
            leg("NO", 0, 0, handling=True),
            leg("NO", 58, "24.83"),
            **LTL,
        )
    )
    assert (row.smart_revenue, row.smart_cost) == (Decimal("649.14"), Decimal("503.29"))


def structures(frame):
    return {r.structure: (r.revenue, r.cost) for r in strategy.structure_counts(frame).collect()}


def test_multidrop_sums_main_rows(make_legs):
    drops = [(107, 90), (40, 33), (30, 25), (52, 44), (76, 63)]
    frame = make_legs(*[leg("YES", r, c, loadId="L") for r, c in drops], **FTL)
    assert structures(frame) == {"multidrop": (305, 255)}


def test_multistop_sums_all_rows(make_legs):
    frame = make_legs(leg("YES", 1529, 1510), leg("NO", 0, 440, handling=True), leg("NO", 500, 400), **FTL)
    assert structures(frame) == {"multistop": (2029, 2350)}


def test_header_lacks_handling_revenue(make_legs, spark):
    frame = make_legs(leg("YES", 0, 0), leg("NO", 300, 0), leg("NO", 66, 0, handling=True), **LTL)
    headers = spark.createDataFrame([("P-1", "300", "0")], "code string, revenueAllocation string, costAllocation string")
    (row,) = strategy.cross_validation(frame, headers).collect()
    assert (row.leg_revenue, row.leg_revenue - row.header_revenue) == (366, 66)


def test_full_amount_on_main_row(make_legs):
    frame = make_legs(leg("YES", 1050, 900), *[leg("NO", 0, 0)] * 3, **FTL)
    by_type = {r.shipmentType: r for r in strategy.profit_by_type(frame).collect()}
    assert (by_type["Full Truckload"].revenue, by_type["Full Truckload"].cost) == (1050, 900)


def test_each_leg_counts_towards_its_own_lane(make_legs):
    day = {"dropWindowFrom": "05/01/2024 10:00:00"}
    frame = make_legs(
        leg("YES", 1200, 0, startMarket="A", endMarket="C"),
        leg("NO", 0, 300, startMarket="A", endMarket="B"),
        leg("NO", 0, 500, startMarket="B", endMarket="C"),
        **LTL,
        **day,
    )
    rows = lanes.lane_profit(frame, LegQuery("2024-05-01", "2024-05-02")).collect()
    assert [(r.lane, r.total_profit) for r in rows] == [("A → C", 1200), ("A → B", -300), ("B → C", -500)]


def test_sub_shipment_that_repeats_the_main_cost(make_legs):
    frame = make_legs(leg("YES", 0, 1000), leg("NO", 0, 1000), **LTL)
    assert order(frame, duplicate_test=True).smart_cost == 1000
    assert order(frame, duplicate_test=True).cost_rule == "3a"
    assert order(frame).smart_cost == 2000


def test_amounts_that_merely_add_up(make_legs):
    frame = make_legs(leg("YES", 0, 162), leg("NO", 0, 100), leg("NO", 0, 65), **LTL)
    row = order(frame, duplicate_test=True)
    assert (row.smart_cost, row.cost_rule) == (327, "3b")


@pytest.mark.parametrize(
    ("amounts", "variant", "rule", "expected"),
    [
        ((100, 0), "additive", 1, 100),
        ((0, 70), "additive", 2, 70),
        ((100, 40), "additive", 4, 140),
        ((100, 40), "main", 4, 100),
        ((100, 50), "additive", 5, 50),
        ((100, 50), "main", 4, 100),
        ((100, 80), "additive", 5, 80),
    ],
)
def test_revenue_rules(make_legs, amounts, variant, rule, expected):
    row = order(make_legs(leg("YES", amounts[0], 0), leg("NO", amounts[1], 0), **LTL), variant=variant)
    assert (row.revenue_rule, row.smart_revenue) == (rule, expected)


@pytest.mark.parametrize(
    ("yes", "no", "handling", "rule", "expected"),
    [(100, 600, 0, "4", 700), (100, 300, 40, "5", 140), (100, 0, 0, "1", 100), (0, 30, 0, "2", 30)],
)
def test_cost_rules(make_legs, yes, no, handling, rule, expected):
    legs = [leg("YES", 0, yes), leg("NO", 0, no - handling), leg("NO", 0, handling, handling=True)]
    row = order(make_legs(*legs, **LTL))
    assert (row.cost_rule, row.smart_cost) == (rule, expected)


def test_lane_of_an_order_without_main_row(make_legs):
    frame = make_legs(leg("NO", 5, 1, startMarket="A", endMarket="B"), **LTL)
    (row,) = strategy.order_metrics(frame).collect()
    assert (row.startMarket, row.endMarket) == ("NA", "NA")


def test_hybrid_takes_legs_before_the_header(make_legs):
    frame = make_legs(
        leg("YES", 85, 10), leg("NO", 42, 5), leg("YES", 70, 1, orderCode="P-2"), leg("NO", 0, 2, orderCode="P-2"), **LTL
    )
    got = {r.orderCode: (r.revenue, r.cost) for r in strategy.hybrid_orders(frame).collect()}
    assert got == {"P-1": (42, 15), "P-2": (70, 3)}


def test_match_rate_counts_orders_within_tolerance(make_legs, spark):
    frame = make_legs(leg("YES", 100, 50), leg("YES", 100, 50, orderCode="P-2"), **LTL)
    headers = spark.createDataFrame(
        [("P-1", "81", "50"), ("P-2", "80", "oops")], "code string, revenueAllocation string, costAllocation string"
    )
    rows = strategy.strategy_match(strategy.smart_orders(frame), headers).collect()
    assert [(r.measure, r.rule, r.orders, r.matched) for r in rows] == [("cost", "1", 1, 1), ("revenue", "1", 2, 1)]


def test_reconciliation_percentages(make_legs, spark):
    frame = make_legs(leg("YES", 40, 30), leg("NO", 60, 90), **LTL)
    headers = spark.createDataFrame([("P-1", "50", "100")], "code string, revenueAllocation string, costAllocation string")
    got = {r.approach: (r.revenue_gap_pct, r.cost_gap_pct) for r in strategy.reconcile(frame, headers).collect()}
    assert got == {"main rows only": (-20.0, -70.0), "sub rows only": (20.0, -10.0), "all rows": (100.0, 20.0)}


def test_patterns_share_all_orders(make_legs):
    frame = make_legs(
        leg("YES", 1, 0), leg("NO", 1, 0, orderCode="P-2"), leg("YES", 1, 0, orderCode="P-3"),
        leg("NO", 1, 0, orderCode="P-3"), leg("YES", 0, 0, orderCode="P-4"), **LTL,
    )
    got = {r.pattern: r.share_pct for r in strategy.pattern_shares(frame).collect()}
    assert got == {"YES_ONLY": 25.0, "NO_ONLY": 25.0, "BOTH": 25.0, "NONE": 25.0}


def test_tonu_orders_are_counted_once(make_legs):
    frame = make_legs(
        leg("NO", 0, 150, accessorialType="TONU"), leg("NO", 10, 50, accessorialType="TONU"), leg("YES", 9, 9), **LTL
    )
    (row,) = strategy.tonu_orders(frame).collect()
    assert (row.tonu_orders, row.tonu_rows, row.tonu_revenue, row.tonu_cost) == (1, 2, 10, 200)


def test_canceled_orders_need_handling(make_legs):
    canceled = {"shipmentStatus": "canceled", "shipmentType": "Less Than Truckload"}
    frame = make_legs(
        leg("YES", 10, 5, orderCode="P-2"),
        leg("NO", 1, 2, handling=True, orderCode="P-2"),
        leg("YES", 10, 5, orderCode="P-3"),
        **canceled,
    )
    kept = strategy.canceled_with_handling(frame).select("orderCode").distinct().collect()
    assert [r.orderCode for r in kept] == ["P-2"]
    (row,) = strategy.canceled_recognition(frame).collect()
    assert (row.completed_orders, row.canceled_orders, row.revenue, row.cost) == (0, 2, 1, 2)
    assert frame.filter(F.col("counted_revenue") > 0).count() == 1
