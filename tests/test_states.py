"""Places without a single task, order states and merges by key."""

import datetime as dt
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.registry import Q, REPORTS, Tables
from lanelytics import LegQuery
from lanelytics.operators import dedup
from lanelytics.operators.order_states import ORDERS, SPAN, number_orders, order_states, states_rollup
from lanelytics.operators.predicates import MARKETS, keys_present, population, standard_population
from lanelytics.operators.ranks import with_places
from lanelytics.operators.rollup import profit_rollup
from lanelytics.plans import lanes
from lanelytics.sources import merge, sinks


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="lanelytics-test-")


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "legs")
    Tables(spark, sf_dir).legs.write.parquet(path)
    return path


@pytest.mark.parametrize("ranges", [1, 2, 64])
def test_places(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.choice([None, 5, 5, 5, rng.randrange(30)]), rng.choice([None, "a", "b", "ü"]), n) for n in range(700)]
    frame = spark.createDataFrame(data, "v int, t string, n int").repartition(5)
    lowest = lambda value: (value is not None, value if value is not None else 0)
    expected = sorted(data, key=lambda r: r[2])
    expected.sort(key=lambda r: (r[1] is not None, r[1] or ""), reverse=True)
    expected.sort(key=lambda r: lowest(r[0]))
    got = sorted(with_places(frame, ("v", "-t", "n"), ranges=ranges).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 701)) and [tuple(r)[:3] for r in got] == expected
    assert with_places(frame.filter("false"), ("v", "n")).collect() == []


@pytest.mark.parametrize(
    ("name", "order"),
    [("lane_profit", lanes.BEST_FIRST), ("similar_mileage", lanes.WORST_PEER_FIRST), ("similar_mileage_tagged", lanes.SELECTED_FIRST)],
)
def test_reports_come_in_their_order(spark, sf_dir, stored, name, order):
    report = REPORTS[name](Tables(spark, sf_dir, stored))
    listed = [tuple(r) for r in report.collect()]
    assert len(listed) > 1 and listed == [tuple(r)[:-1] for r in sorted(with_places(report, order).collect(), key=lambda r: r.place)]


def test_flags_of_a_stop_with_most_rows(make_legs):
    """Shares of a stop, equal legs and legs without id or time."""
    rows = [{"loadId": "L", "warpId": f"S-{n % 90:02d}", "pickTimeArrived": f"05/01/2024 {n % 5:02d}:00:00"} for n in range(300)]
    rows += [{"loadId": "M", "warpId": "S-1"}] * 40 + [{"loadId": None, "warpId": None}] * 3
    flagged = dedup.with_keep_flags(make_legs(*rows)).collect()
    assert len(flagged) == 343
    kept = sorted((r.loadId or "", r.warpId or "", r.pickTimeArrived or "") for r in flagged if r.keep_for_pickup)
    assert kept == [("", "", ""), ("L", "S-00", "05/01/2024 00:00:00"), ("M", "S-1", "")]
    assert sum(r.keep_for_delivery for r in flagged) == 3


def day(d, warp_id, hour=10, **more):
    return {
        "dropWindowFrom": f"05/{d:02d}/2024 {hour:02d}:00:00", "warpId": warp_id, "dropLocationName": "B", "shipmentStatus": "Complete",
        "startMarket": "A", "endMarket": "B", "revenueAllocationNumber": 1, "orderCode": f"P-{warp_id}", **more,
    }


@pytest.fixture
def shipped_legs(make_legs):
    rng = random.Random(11)
    rows = [
        day(
            rng.randrange(1, 9), f"S-{n}", rng.choice([0, 0, 10]), orderCode=rng.choice([None, "P-hot", f"P-{rng.randrange(60)}"]),
            startMarket=rng.choice(["A", "B", ""]), endMarket=rng.choice(["A", "B", None]), revenueAllocationNumber=n % 13,
            shipmentStatus=rng.choice(["Complete", "canceled", "Pending"]), accessorialType=rng.choice([None, "TONU"]),
            shipmentType=rng.choice(["Full Truckload", None]), mainShipment=rng.choice(["YES", "NO"]), shipmentMiles=float(n % 7),
        )
        for n in range(400)
    ]
    return make_legs(*rows, day(1, "S-bad", dropWindowFrom="bad")).cache()


@pytest.mark.parametrize(
    "query",
    [
        LegQuery("2024-05-01", "2024-05-31"),
        LegQuery("2024-05-03", "2024-05-05"),
        LegQuery("2024-05-03", "2024-05-05", inclusive_end=True),
        LegQuery("2024-05-04", "2024-05-04"),
        LegQuery("2024-05-02", "2024-05-07", shipment_type="Full Truckload", lanes=("A → B", "B → B")),
        LegQuery("2023-05-02", "2023-05-07"),
    ],
)
def test_states_answer_any_range(shipped_legs, query):
    states = order_states(shipped_legs, number_orders(shipped_legs))
    names = ["startMarket", "endMarket", "order_count", "completed_orders", "canceled_orders", "total_profit", "tonu_rows", "avg_main_miles"]
    live = profit_rollup(population(shipped_legs, query), MARKETS).select(*names)
    assert sorted(map(tuple, states_rollup(states, query).select(*names).collect())) == sorted(map(tuple, live.collect()))
    with pytest.raises(ValueError):
        states_rollup(states, LegQuery("2024-05-01", "2024-05-31", customers=("C",)))


def test_numbers_stay_and_states_are_merged(spark, shipped_legs, folder):
    first = shipped_legs.filter("delivery_ts < '2024-05-05'")
    number_orders(first).write.parquet(f"{folder}/numbers")
    known = spark.read.parquet(f"{folder}/numbers")
    later = number_orders(shipped_legs, known)
    numbers = known.unionByName(later).collect()
    assert sorted(r.order_no for r in numbers) == list(range(len(numbers))) and len({r.orderCode for r in numbers}) == len(numbers)
    later.write.mode("append").parquet(f"{folder}/numbers")
    numbers = spark.read.parquet(f"{folder}/numbers")
    for part in (first, shipped_legs.filter("delivery_ts >= '2024-05-05'")):
        sinks.refresh_states(order_states(part, numbers), f"{folder}/states", [])
    query = LegQuery("2024-05-02", "2024-05-07")
    stored = merge.read_dates(spark, f"{folder}/states")
    assert lanes.lane_profit_of_range(stored, query).collect() == lanes.lane_profit(shipped_legs, query).collect()
    plan = lanes.lane_profit_of_range(stored, query)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(delivery_date" in plan
    sinks.refresh_states(order_states(shipped_legs.filter("false"), numbers), f"{folder}/states", [dt.date(2024, 5, 3)])
    left = shipped_legs.filter("to_date(delivery_ts) <> '2024-05-03'")
    assert lanes.lane_profit_of_range(stored.sparkSession.read.parquet(f"{folder}/states"), query).collect() == lanes.lane_profit(left, query).collect()


def contents(frame):
    names = ("warpId", "delivery_date", "counted_revenue", "lane")
    return sorted(map(str, frame.select(*names).collect()))


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def test_merge_equals_a_rebuild(spark, make_legs, folder):
    path = f"{folder}/legs"
    stored = make_legs(*[day(d, f"S-{d}-{n}") for d in range(1, 9) for n in range(10)], day(9, "S-alone"), day(1, "S-bad", dropWindowFrom="bad"))
    sinks.write_enriched(stored, path)
    before = files(path)
    batch = [
        *[day(2, f"S-late-{n}") for n in range(3)],  # late: eight other legs of the day stay
        day(2, "S-2-1", revenueAllocationNumber=7),  # corrected
        day(20, "S-3-4"), day(20, "S-alone"),  # moved, one from a date that is empty then
        day(5, "S-bad"),  # readable now
        day(6, "S-7-7", dropWindowFrom="worse"),  # and no longer
        day(2, "S-2-2"), day(2, "S-2-2"),  # a repeated key
    ]
    changed, withdrawn = make_legs(*batch), spark.createDataFrame([("S-4-0",), ("S-4-1",), ("S-none",)], "warpId string")
    dates = sinks.merge_enriched(changed, path, withdrawn)
    assert dates == [None, *[dt.date(2024, 5, d) for d in (2, 3, 4, 5, 7, 9, 20)]]
    wanted = merge.with_date(merge.merged(stored, changed, withdrawn))
    assert contents(sinks.read_enriched(spark, path)) == contents(wanted)
    untouched = {name for name in before if any(f"2024-05-0{d}" in name for d in (1, 6, 8))}
    assert untouched and untouched <= files(path)  # dates without a changed key are the same files
    assert not list(Path(path).glob("delivery_date=2024-05-09"))
    assert sinks.merge_enriched(changed, path, withdrawn) == [None, *[dt.date(2024, 5, d) for d in (2, 5, 20)]]
    assert contents(sinks.read_enriched(spark, path)) == contents(wanted)
    moved_on = make_legs(day(21, "S-3-4"))
    assert sinks.merge_enriched(moved_on, path) == [dt.date(2024, 5, 20), dt.date(2024, 5, 21)]
    assert contents(sinks.read_enriched(spark, path)) == contents(merge.merged(wanted, merge.with_date(moved_on)))


def test_whole_dates_written_later_are_known_to_merges(spark, make_legs, folder):
    path = f"{folder}/legs"
    sinks.write_enriched(make_legs(day(1, "S-1"), day(2, "S-2")), path)
    merge.index_keys(spark, path)
    sinks.write_enriched(make_legs(day(2, "S-3"), day(3, "S-4")), path)
    assert sinks.merge_enriched(make_legs(day(9, "S-3"), day(9, "S-4")), path) == [dt.date(2024, 5, d) for d in (2, 3, 9)]
    left = {(r.warpId, r.delivery_date.day) for r in sinks.read_enriched(spark, path).collect()}
    assert left == {("S-1", 1), ("S-3", 9), ("S-4", 9)}


def test_merges_read_few_dates_and_need_keys(spark, make_legs, folder):
    path = f"{folder}/legs"
    sinks.write_enriched(make_legs(*[day(d, f"S-{d}") for d in range(1, 9)]), path)
    with pytest.raises(ValueError, match="warpId"):
        sinks.merge_enriched(make_legs(day(1, None)), path)
    old = merge.read_dates(spark, path).filter(merge.on_dates([None, dt.date(2024, 5, 2)]))
    plan = merge.merged(old, merge.with_date(make_legs(day(2, "S-2"))))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "2024-05-02" in plan
    assert sinks.merge_enriched(make_legs(day(1, "S-1")).filter("false"), path) == []
    assert sinks.merge_enriched(make_legs(day(1, "S-1")).filter("false"), path, spark.createDataFrame([("S-5",)], "warpId string")) == [dt.date(2024, 5, 5)]
    assert sorted(r.warpId for r in sinks.read_enriched(spark, path).collect()) == [f"S-{d}" for d in (1, 2, 3, 4, 6, 7, 8)]


def lane_groups(path, lane):
    """(row groups, and those whose least and greatest values admit a lane, bytes of both)."""
    import pyarrow.parquet as pq

    every, admitted = [], []
    for file in Path(path).rglob("*.parquet"):
        metadata = pq.ParquetFile(file).metadata
        names = metadata.schema.names
        for n in range(metadata.num_row_groups):
            group = metadata.row_group(n)
            every.append(group.total_byte_size)
            limits = [group.column(names.index(c)).statistics for c in lane]
            if all(s.has_min_max and s.min <= value <= s.max for s, value in zip(limits, lane.values())):
                admitted.append(group.total_byte_size)
    return len(every), len(admitted), sum(every), sum(admitted)


def test_clustered_legs_skip_other_lanes(spark, make_legs, folder):
    rng = random.Random(5)
    legs = make_legs(
        *[
            day(1 + n % 2, f"S-{n}", startMarket=f"M{rng.randrange(30):02d}", endMarket=f"M{rng.randrange(30):02d}", clientName=f"C{rng.randrange(40)}")
            for n in range(6000)
        ]
    ).cache()
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        sinks.write_enriched(legs, f"{folder}/plain")
        sinks.write_enriched(legs, f"{folder}/clustered", cluster=sinks.LANE_AND_CUSTOMER)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    lane = {"startMarket": "M07", "endMarket": "M11"}
    plain, clustered = lane_groups(f"{folder}/plain", lane), lane_groups(f"{folder}/clustered", lane)
    assert plain[1] > 0.9 * plain[0] and clustered[1] < 0.35 * clustered[0]
    client = [lane_groups(f"{folder}/{kind}", {"clientName": "C7"}) for kind in ("plain", "clustered")]
    assert client[0][1] > 0.9 * client[0][0] and client[1][1] < 0.6 * client[1][0]
    stored = sinks.read_enriched(spark, f"{folder}/clustered")
    assert contents(stored) == contents(merge.with_date(legs))
    query = LegQuery("2024-05-01", "2024-05-31")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = population(stored, query).filter("startMarket = 'M07' AND endMarket = 'M11'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    print("row groups and bytes, plain and clustered:", plain, clustered, client)
    assert "EqualTo(startMarket,M07)" in plan and "EqualTo(endMarket,M11)" in plan


def test_sketches_of_days(make_legs):
    from lanelytics.plans import quality

    legs = merge.with_date(make_legs(*[day(1 + n % 5, f"S-{n % 3000}", startMarket=f"M{n % 60}", pickCity="A", dropCity=None) for n in range(6000)]))
    sketches = quality.lane_sketches(legs)
    assert sketches.count() == 5
    row = quality.estimated_lanes(sketches, "2024-05-02", "2024-05-04").first()
    exact = legs.filter("delivery_date BETWEEN '2024-05-02' AND '2024-05-04'").select(F.countDistinct("warpId"), F.countDistinct("startMarket")).first()
    assert row.city_lanes == 0 and abs(row.legs - exact[0]) <= 0.05 * exact[0] and abs(row.market_lanes - exact[1]) <= 2
    assert quality.estimated_lanes(sketches, "2023-01-01", "2023-01-02").first().legs == 0


def test_bitmaps_are_built_of_words(spark, sf_dir):
    """As Spark's bitmap aggregates give them, whose buffers of 4,096 bytes a group would be sorted and shuffled."""
    legs = Tables(spark, sf_dir).legs
    numbers = legs.filter("orderCode IS NOT NULL").select("orderCode", (F.substring("orderCode", 3, 20).cast("bigint") % 5000).alias("order_no"))
    numbers = numbers.distinct()
    states = order_states(legs, numbers)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (states, lanes.lane_profit_of_range(states, Q))]
    assert not any("bitmap" in plan for plan in plans)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in states.groupBy("span", "shipmentType").agg(
        *[F.hex(F.substring(F.bitmap_or_agg(name), 1, 64)) for name in ORDERS], F.min(F.octet_length("order_count"))).collect()}
    used = legs.filter(standard_population() & keys_present(*MARKETS) & F.col("delivery_ts").isNotNull()).join(numbers, "orderCode", "left")
    bit = F.col("order_no") % SPAN
    bits = [bit if status is None else F.when(F.col("shipmentStatus") == status, bit) for status in ORDERS.values()]
    expected = used.groupBy(F.floor(F.col("order_no") / SPAN).alias("span"), "shipmentType").agg(
        *[F.hex(F.substring(F.bitmap_construct_agg(b), 1, 64)) for b in bits], F.lit(64))
    assert got == {tuple(r)[:2]: tuple(r)[2:] for r in expected.collect()} and len(got) > 5
