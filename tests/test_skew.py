"""Groups that hold a large part of all rows, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanelytics.operators import dedup, quantile
from lanelytics.operators.groups import lookup_join, semi_join, with_group_sums
from lanelytics.operators.order_stats import rows_to_use, with_order_counts
from lanelytics.operators.quantile import exact_percentiles
from lanelytics.plans import strategy


@pytest.fixture(scope="module")
def skewed(make_legs):
    """Every third row belongs to one order, load and site."""
    rng = random.Random(7)
    rows = []
    for n in range(900):
        hot = n % 3 == 0
        rows.append(
            {
                "orderCode": "P-hot" if hot else f"P-{rng.randrange(200)}",
                "loadId": "L-hot" if hot else f"L-{rng.randrange(50)}",
                "mainShipment": rng.choice(["YES", "NO", None]),
                "carrierName": "C" if hot else rng.choice(["C", "D", None]),
                "pickLocationName": "A",
                "dropLocationName": rng.choice(["A", "B"]),
                "pickTimeArrived": f"05/0{rng.randrange(1, 3)}/2024 {rng.randrange(24):02d}:00:00",
                "revenueAllocationNumber": rng.randrange(100),
                "costAllocationNumber": rng.randrange(100),
                "shipmentType": "Less Than Truckload",
                "shipmentStatus": "Complete",
            }
        )
    return make_legs(*rows).cache()


def test_order_counts(skewed):
    rows = skewed.collect()
    total, main = Counter(r.orderCode for r in rows), Counter(r.orderCode for r in rows if r.mainShipment == "YES")
    got = with_order_counts(skewed).collect()
    assert len(got) == len(rows)
    assert all((r.order_rows, r.order_main_rows) == (total[r.orderCode], main[r.orderCode]) for r in got)


def test_null_is_a_group_like_any_other(make_legs):
    frame = make_legs({"orderCode": None, "mainShipment": "YES"}, {"orderCode": None}, {"orderCode": "P-1"})
    got = sorted((r.warpId, r.order_rows, r.order_main_rows) for r in with_order_counts(frame).collect())
    assert got == [("S-0", 2, 1), ("S-1", 2, 1), ("S-2", 1, 0)]
    full = make_legs({"orderCode": None, "mainShipment": "YES", "shipmentType": "Full Truckload"})
    assert rows_to_use(full, "carrier").count() == 1


def test_a_large_group_can_be_split(skewed):
    """Both sides of the join come from a shuffle of their own, directly below its sort."""
    frame = with_group_sums(skewed, ["orderCode"], {"n": F.lit(1)})
    assert frame.filter("orderCode = 'P-hot'").select("n").distinct().collect()[0].n == 300
    session = skewed.sparkSession
    before = session.conf.get("spark.sql.autoBroadcastJoinThreshold")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = with_group_sums(skewed, ["orderCode"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    finally:
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    sorts = [n for n, line in enumerate(lines) if line.startswith("Sort ")]
    assert len(sorts) == 2 and all("ENSURE_REQUIREMENTS" in lines[n + 1] for n in sorts)


def test_semi_and_lookup_joins(skewed, spark):
    wanted = spark.createDataFrame([("P-hot", 1), ("P-3", 2), ("P-none", 3)], "orderCode string, fact int")
    rows = skewed.collect()
    expected = sorted(r.warpId for r in rows if r.orderCode in ("P-hot", "P-3"))
    assert sorted(r.warpId for r in semi_join(skewed, wanted.select("orderCode"), "orderCode").collect()) == expected
    looked_up = lookup_join(skewed, wanted, "orderCode").collect()
    assert sorted(r.warpId for r in looked_up) == expected
    assert {(r.orderCode, r.fact) for r in looked_up} <= {("P-hot", 1), ("P-3", 2)}


def test_first_per_stop_and_flags(skewed):
    stops = defaultdict(list)
    for r in skewed.collect():
        key = (r.loadId, r.carrierName, r.pickLocationName, r.pick_arrived_ts.date())
        stops[key].append((r.pick_arrived_ts, r.warpId))
    expected = sorted(min(group)[1] for group in stops.values())
    kept = dedup.first_per_stop(skewed, "pick")
    assert sorted(r.warpId for r in kept.collect()) == expected
    assert sorted(r.warpId for r in dedup.first_per_stop(kept, "pick").collect()) == expected
    twice = skewed.limit(1).unionByName(skewed.limit(1)).withColumn("loadId", F.lit("L-twice"))
    assert sorted(r.keep_for_pickup for r in dedup.with_keep_flags(twice).collect()) == [False, True]
    flagged = dedup.with_keep_flags(skewed).collect()
    assert len(flagged) == 900
    assert sorted(r.warpId for r in flagged if r.keep_for_pickup) == expected


def test_duplicate_test(skewed, make_legs):
    rows = [
        {
            "orderCode": f"P-{n}",
            "mainShipment": main,
            "costAllocationNumber": cost,
            "pickLocationName": "A",
            "dropLocationName": "B",
            "warpId": f"{n}-{i}",
        }
        for n, costs in enumerate([(100, [100]), (100, [40, 60]), (100, [99.5, 1]), (0, [0, 0]), (50, [400]), (9, [])])
        for i, (main, cost) in enumerate([("YES", costs[0]), *[("NO", c) for c in costs[1]]])
    ]
    orders = strategy.smart_orders(make_legs(*rows), duplicate_test=True)
    got = {r.orderCode: (r.cost_rule, float(r.smart_cost)) for r in orders.collect()}
    assert got == {
        "P-0": ("3a", 100.0),
        "P-1": ("3b", 200.0),
        "P-2": ("3a", 100.0),
        "P-3": ("3a", 0.0),
        "P-4": ("4", 450.0),
        "P-5": ("1", 9.0),
    }
    by_order = defaultdict(lambda: [0, []])
    for r in skewed.collect():
        if r.mainShipment == "YES":
            by_order[r.orderCode][0] += r.costAllocationNumber
        elif r.mainShipment == "NO":
            by_order[r.orderCode][1].append(r.costAllocationNumber)
    for r in strategy.smart_orders(skewed, duplicate_test=True).collect():
        yes, subs = by_order[r.orderCode]
        if r.cost_rule.startswith("3"):
            assert (r.cost_rule == "3a") == any(abs(c - yes) < 1 for c in subs)


@pytest.mark.parametrize(("copies", "small"), [(1, 10**6), (7, 10**6), (1, 50), (7, 50)])
def test_percentiles_are_exact(spark, copies, small, monkeypatch):
    monkeypatch.setattr(quantile, "SMALL", small)
    rng = random.Random(copies)
    values = [rng.choice([0.25, rng.gauss(0, 5)]) for _ in range(500)] * copies
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double").repartition(5)
    probabilities = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = {r.probability: r.value for r in exact_percentiles(frame, "v", probabilities).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_percentiles_per_key(spark):
    rng = random.Random(3)
    data = [(k, float(rng.randrange(50))) for k in "aaaaaab" for _ in range(60)]
    frame = spark.createDataFrame(data, "k string, v double")
    got = {(r.k, r.probability): r.value for r in exact_percentiles(frame, "v", [0.25, 0.9], ["k"]).collect()}
    for key in "ab":
        for p in (0.25, 0.9):
            assert got[key, p] == pytest.approx(np.quantile([v for k, v in data if k == key], p))


def test_percentiles_of_one_value_and_none(spark):
    one = spark.createDataFrame([(4.0,)], "v double")
    assert [r.value for r in exact_percentiles(one, "v", [0.1, 0.9]).collect()] == [4.0, 4.0]
    assert exact_percentiles(one.filter("false"), "v", [0.5]).collect() == []
