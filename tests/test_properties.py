"""Relations between reports that must hold on any data."""

import pytest
from pyspark.sql import functions as F

from checks import sample
from checks.registry import Q, Tables
from lanelytics import enrich
from lanelytics.operators.predicates import MARKETS, ZIPS, population
from lanelytics.operators.rollup import profit_rollup
from lanelytics.plans import breakdowns, drilldown, lanes


@pytest.fixture(scope="module")
def legs(spark, sf_dir):
    return Tables(spark, sf_dir).legs


def sums(frame, *names):
    return tuple(frame.agg(*[F.sum(n).alias(n) for n in names]).first())


MONEY = ("total_revenue", "total_cost", "crossdock_cost", "tonu_revenue", "tonu_cost")


@pytest.mark.parametrize("keys", [MARKETS, ZIPS], ids=["markets", "zips"])
def test_groups_add_up_to_the_whole(legs, keys):
    rows = population(legs, Q, keys)
    assert sums(profit_rollup(rows, keys), *MONEY) == sums(profit_rollup(rows), *MONEY)


def test_handling_cost_is_part_of_the_cost(legs):
    assert profit_rollup(population(legs, Q), MARKETS).filter("crossdock_cost > total_cost").count() == 0


def test_customers_add_up_to_their_lane(legs):
    lane = lanes.lane_profit(legs, Q).first()
    customers = breakdowns.lane_customers(legs, Q, breakdowns.market_lane(lane.startMarket, lane.endMarket))
    assert sums(customers, "total_revenue", "total_cost") == (lane.total_revenue, lane.total_cost)


def test_details_add_up_to_their_lane(legs):
    lane = lanes.lane_profit(legs, Q).first()
    details = breakdowns.order_details(legs, Q, breakdowns.market_lane(lane.startMarket, lane.endMarket))
    assert sums(details, "revenue", "cost") == (lane.total_revenue, lane.total_cost)
    headline = drilldown.drill_headline(legs, Q, lane=lane.lane).first()
    assert (headline.total_revenue, headline.total_cost) == (lane.total_revenue, lane.total_cost)


def test_partitioning_and_row_order_do_not_matter(legs):
    shuffled = legs.orderBy(F.rand(5)).repartition(3)
    assert lanes.lane_profit(shuffled, Q).collect() == lanes.lane_profit(legs, Q).collect()


def test_stored_and_live_legs_agree(spark, sf_dir, legs):
    live = enrich(sample.legs(spark, sf_dir))
    assert lanes.lane_diagnostics(live, Q).collect() == lanes.lane_diagnostics(legs, Q).collect()


def test_distinct_orders_match_the_built_in_count(legs):
    rows = population(legs, Q)
    built_in = rows.groupBy(*MARKETS).agg(
        F.countDistinct("orderCode").alias("orders"),
        F.countDistinct(F.when(F.col("shipmentStatus") == "canceled", F.col("orderCode"))).alias("canceled"),
    )
    ours = profit_rollup(rows, MARKETS).select(
        *MARKETS, F.col("order_count").alias("orders"), F.col("canceled_orders").alias("canceled")
    )
    assert ours.exceptAll(built_in).count() == 0
    assert built_in.exceptAll(ours).count() == 0
