"""What the physical plans must and must not contain."""

import re

import pytest

from checks import sample
from checks.registry import REPORTS, Tables


@pytest.fixture(scope="module")
def enriched(spark, sf_dir, tmp_path_factory):
    """A stored copy of the enriched legs, as users have."""
    path = str(tmp_path_factory.mktemp("enriched") / "legs")
    Tables(spark, sf_dir).legs.write.parquet(path)
    return path


@pytest.fixture(scope="module")
def plan_of(spark, sf_dir, enriched):
    def plan(name, broadcast=True):
        wanted = {"spark.sql.maxMetadataStringLength": "10000"}
        if not broadcast:
            wanted["spark.sql.autoBroadcastJoinThreshold"] = "-1"
        before = {key: spark.conf.get(key) for key in wanted}
        for key, value in wanted.items():
            spark.conf.set(key, value)
        try:
            frame = REPORTS[name](Tables(spark, sf_dir, enriched))
            return frame._jdf.queryExecution().executedPlan().toString()
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)

    return plan


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_plan_multiplies_rows_or_leaves_the_jvm(plan_of, name):
    plan = plan_of(name, broadcast=False)
    for operator in ("CartesianProduct", "NestedLoop", "Expand ", "Python"):
        assert operator not in plan, operator
    # sketches of percentiles, and the legs of a route in the test tables
    gathers = {"margin_summary", "margin_distribution", "legs_with_routes", "route_agreement", "legs_on_routes"}
    # the bounds and counts of at most 64 ranges
    ranges = name.endswith("_in_order") or "_from_states" in name
    sketches = name == "distinct_lanes_estimated"
    assert ("ObjectHashAggregate" in plan) <= (name in gathers or ranges or sketches)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_window_holds_all_rows(plan_of, name):
    """But for those over the rows of periods, of which there is one per week or month."""
    specifications = re.findall(r"windowspecdefinition\(([^,()]*)", plan_of(name))
    alone = [s for s in specifications if re.search(r" (ASC|DESC) ", s)]
    assert not alone or name in ("weekly_change", "monthly_change")


def test_building_a_report_starts_no_job(spark, sf_dir):
    spark.sparkContext.setJobGroup("building", "reports")
    try:
        for name in ("lane_profit", "margin_summary", "margin_distribution", "legs_on_routes", "similar_mileage"):
            REPORTS[name](Tables(spark, sf_dir))
        # reading the footers of the tables is all that Spark does
        tracker = spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup("building")
        assert all(tracker.getStageInfo(s).name.startswith("parquet") for j in jobs for s in tracker.getJobInfo(j).stageIds)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(
    ("name", "scans"),
    [("keep_flags", 1), ("order_row_counts", 2), ("carrier_shipment_counts", 2), ("canceled_with_handling", 3)]
    + [("lane_carriers", 1), ("zip_carriers", 1), ("zip_diagnostics", 1), ("similar_mileage_tagged", 2)],
)
def test_legs_are_read_as_few_times_as_needed(plan_of, name, scans):
    assert plan_of(name).count("FileScan") <= scans


def test_legs_are_counted_on_peers_only(plan_of):
    """The lanes are found first and met by the legs before these are counted."""
    plan = plan_of("similar_mileage_tagged")
    counted = plan[: plan.rindex("warpId") + 1]
    assert re.search(r"HashAggregate\(keys=\[[^\]]*warpId", counted) and "Join" in plan
    assert plan.index("Join") > re.search(r"HashAggregate\(keys=\[[^\]]*warpId", plan).start()


@pytest.mark.parametrize("name", ["lane_profit", "lane_diagnostics", "market_profit", "lane_customers"])
def test_sorted_profit_reports_shuffle_three_times(plan_of, name):
    plan = plan_of(name)
    assert plan.count("Exchange") == 3
    assert plan.count("FileScan") == 1
    assert "SortAggregate" not in plan


def test_first_shuffle_is_spread_by_order(plan_of):
    plan = plan_of("lane_profit")
    assert "hashpartitioning(startMarket" in plan
    first = plan.rindex("Exchange hashpartitioning")
    assert "orderCode" in plan[first:].splitlines()[0]
    assert "partial_sum" in plan[first:]


def test_filters_and_columns_reach_the_scan(plan_of):
    scan = plan_of("lane_profit")
    pushed = scan[scan.index("PushedFilters") :]
    for part in ("GreaterThanOrEqual(delivery_date", "In(shipmentStatus", "EqualTo(accessorialType,TONU)"):
        assert part in pushed, part
    columns = scan[scan.index("ReadSchema") :]
    assert "equipment" not in columns and "pickCity" not in columns


@pytest.mark.parametrize("name", ["carrier_otp", "site_otd", "pickup_dedup"])
def test_stops_shrink_before_they_are_shuffled(plan_of, name):
    plan = plan_of(name)
    assert plan.count("WindowGroupLimit") == 2
    assert plan.rindex("WindowGroupLimit") > plan.rindex("Exchange hashpartitioning(loadId")


@pytest.mark.parametrize("name", ["drill_detail_lane_short", "customer_list_short", "top_lanes", "multi_leg_allocations"])
def test_limits_are_taken_per_partition(plan_of, name):
    assert "TakeOrderedAndProject" in plan_of(name)


@pytest.mark.parametrize("name", ["zip_diagnostics", "order_metrics"])
def test_text_maxima_do_not_sort_all_rows(plan_of, name):
    """Below every sort aggregate there is a hash aggregate and a shuffle first."""
    plan = plan_of(name, broadcast=False)
    assert "HashAggregate" in plan[plan.rindex("SortAggregate") :]


@pytest.mark.parametrize("name", ["lane_profit", "zip_diagnostics", "keep_flags", "weekly_change_of_every_week", "service_against_targets"])
def test_code_over_live_legs_can_be_compiled(spark, sf_dir, capsys, name):
    """The delivery time is worked out once a row; the virtual machine interprets methods of more than 8,000 bytes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        REPORTS[name](Tables(spark, sf_dir)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["lane_profit_ftl", "zip_diagnostics_all", "similar_mileage_tagged", "market_profit_headline", "lanes_named_na"])
def test_live_legs_are_filtered_before_they_meet_their_orders(spark, sf_dir, name):
    """Between the line items and their first join there is the filter on the delivery time."""
    plan = REPORTS[name](Tables(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    generated = [n for n, line in enumerate(plan.splitlines()) if "Generate explode" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    for at in generated:
        above = [line for n, line in enumerate(lines[:at]) if depth(line) < min(map(depth, lines[n + 1 : at + 1]))]
        joins = [n for n, line in enumerate(above) if "Join" in line]
        assert any("Filter" in line and "delivery_ts" in line for line in above[joins[-1] :]), plan
    assert generated


@pytest.mark.parametrize("name", ["similar_mileage_in_order", "similar_mileage_tagged_in_order"])
def test_places_of_lanes_do_not_read_legs_again(spark, sf_dir, name):
    assert "FileScan" not in REPORTS[name](Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "shuffles"), [("keep_flags", 3), ("service_against_targets", 2)])
def test_stops_of_both_ends_are_read_once(plan_of, name, shuffles):
    plan = plan_of(name)
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == shuffles


def test_live_legs_equal_enriched_ones(spark, sf_dir):
    live, derived = sample.enriched_legs(spark, sf_dir), sample.with_dates(sample.legs(spark, sf_dir))
    assert live.schema == derived.schema
    assert live.exceptAll(derived).isEmpty() and derived.exceptAll(live).isEmpty()
