"""Reading, landing and writing."""

import tempfile
from types import SimpleNamespace

import pytest

from checks import sample
from lanelytics import LegQuery
from lanelytics.operators.predicates import matching
from lanelytics.plans import companions, lanes
from lanelytics.sources import sinks, tables
from lanelytics.sources.schema import CARRIERS, CLIENTS, LEGS, ORDER_HEADERS, ROUTES, SHIPMENTS


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="lanelytics-test-")


def test_partial_extract_is_conformed(spark, folder):
    extract = spark.createDataFrame(
        [("P-1", "COMPLETE", "12.5", "x")], "ordercode string, shipmentStatus string, totalCost string, extra string"
    )
    extract.write.parquet(f"{folder}/legs")
    with pytest.raises(ValueError, match="warpId"):
        tables.read_legs(spark, f"{folder}/legs")
    absent = {f.name for f in LEGS} - {"orderCode", "shipmentStatus", "totalCost"}
    legs = tables.read_legs(spark, f"{folder}/legs", allow_missing=absent)
    assert [(f.name, f.dataType) for f in legs.schema] == [(f.name, f.dataType) for f in LEGS]
    row = legs.first()
    assert (row.orderCode, row.shipmentStatus, str(row.totalCost), row.warpId) == ("P-1", "Complete", "12.5000", None)


@pytest.mark.parametrize(
    ("name", "schema"),
    [
        ("legs", LEGS),
        ("order_headers", ORDER_HEADERS),
        ("routes", ROUTES),
        ("carriers", CARRIERS),
        ("clients", CLIENTS),
        ("shipments", SHIPMENTS),
    ],
)
def test_sample_tables_have_the_declared_schemas(spark, sf_dir, name, schema):
    frame = sample.TABLES[name](spark, sf_dir)
    assert {f.name: f.dataType for f in frame.schema} == {f.name: f.dataType for f in schema}


def test_sample_rows_are_unique_legs(spark, sf_dir):
    legs = sample.enriched_legs(spark, sf_dir)
    assert legs.count() == legs.select("warpId").distinct().count() == 6000
    assert legs.select("orderCode").distinct().count() == 1473
    assert legs.filter("is_crossdock").count() == 303
    assert legs.filter("is_tonu").count() == 135


def test_values_are_bound_not_spliced(spark, make_legs):
    frame = make_legs({"clientName": "O'Neil"}, {"clientName": "x' OR '1'='1"})
    got = tables.run_sql(spark, "SELECT clientName FROM {legs} WHERE clientName = :who", {"who": "O'Neil"}, legs=frame)
    assert [r.clientName for r in got.collect()] == ["O'Neil"]
    query = LegQuery("0001-01-01", "9999-12-31", customers=("x' OR '1'='1",))
    assert "OR '1'='1" in matching(frame, query)._jdf.queryExecution().optimizedPlan().toString()


def test_code_arrays(spark):
    frame = spark.createDataFrame(
        [("R-1", '["S-1","S-2","S-3"]'), ("R-2", "[]"), ("R-3", "not json"), ("R-4", None)],
        "routeId string, shipmentCodes string",
    )
    got = tables.explode_codes(frame, "shipmentCodes", "code").collect()
    assert [(r.routeId, r.code) for r in got] == [("R-1", "S-1"), ("R-1", "S-2"), ("R-1", "S-3")]


def test_legs_listed_by_routes(spark, make_legs):
    frame = make_legs({"warpId": "S-1"}, {"warpId": "S-2"}, {"warpId": "S-9"})
    routes = spark.createDataFrame([("R-1", '["S-1","S-2","S-3"]')], "routeId string, shipmentCodes string")
    assert sorted(r.warpId for r in companions.legs_on_routes(frame, routes).collect()) == ["S-1", "S-2"]


def test_shipment_links_go_one_step_up(spark, make_legs):
    frame = make_legs({"shipmentWarpId": "S-7"}, {"shipmentWarpId": "S-7"}, {"shipmentWarpId": "S-5"})
    shipments = spark.createDataFrame(
        [("7", "S-5", "S-7-2401"), ("5", "S-1", "S-5-2401"), ("1", None, "S-1-2401")],
        "warpId string, parent string, code string",
    )
    got = {(r.shipmentWarpId, r.parent_code, r.legs) for r in companions.shipment_links(frame, shipments).collect()}
    assert got == {("S-7", "S-5-2401", 2), ("S-5", "S-1-2401", 1)}


def test_legs_without_a_route_are_kept(spark, make_legs):
    frame = make_legs({"loadId": "L1", "carrierName": "C"}, {"loadId": "L2", "carrierName": "C"}, {"loadId": None})
    routes = spark.createDataFrame([("L1", "D")], "routeId string, carrierName string")
    assert companions.legs_with_routes(frame, routes).count() == 3
    got = {r.agreement: r.legs for r in companions.route_agreement(frame, routes).collect()}
    assert got == {"different": 1, "unknown": 2}


def test_enriched_table_is_pruned_by_date(spark, make_legs, folder):
    frame = make_legs(
        *[{"dropWindowFrom": f"05/{d:02d}/2024 10:00:00", "dropLocationName": "B"} for d in range(1, 11)],
        {"dropWindowFrom": "bad"},
        shipmentStatus="Complete", startMarket="A", endMarket="B", revenueAllocationNumber=1,
    )
    sinks.write_enriched(frame, f"{folder}/enriched")
    stored = sinks.read_enriched(spark, f"{folder}/enriched")
    assert stored.count() == 11
    query = LegQuery("2024-05-03", "2024-05-05")
    assert "PartitionFilters: [isnotnull(delivery_date" in (
        matching(stored, query)._jdf.queryExecution().executedPlan().toString()
    )
    live = lanes.lane_profit(frame, query).collect()
    assert lanes.lane_profit(stored, query).collect() == live
    assert live[0].completed_orders == 1 and live[0].total_revenue == 2


def test_csv_and_report_sinks(spark, make_legs, folder):
    frame = make_legs({"startMarket": "A", "endMarket": "B, C"}).select("lane", "warpId")
    sinks.write_csv(frame, f"{folder}/csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").collect() == frame.collect()
    sinks.write_report(frame, f"{folder}/report")
    assert spark.read.parquet(f"{folder}/report").collect() == frame.collect()


def test_only_the_dates_written_are_replaced(spark, make_legs, folder):
    def day(d, **more):
        return {"dropWindowFrom": f"05/{d:02d}/2024 10:00:00", "dropLocationName": "B", **more}

    sinks.write_enriched(make_legs(day(1), day(2), day(2)), f"{folder}/enriched")
    sinks.write_enriched(make_legs(day(2, warpId="S-new")), f"{folder}/enriched")
    days = sinks.read_enriched(spark, f"{folder}/enriched").groupBy("delivery_date").count().collect()
    assert sorted((r.delivery_date.day, r["count"]) for r in days) == [(1, 1), (2, 1)]


def test_server_tables_are_read_in_slices():
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def options(self, **options):
            self.seen.update(options)
            return self

        def option(self, key, value):
            self.seen[key] = value
            return self

        def load(self):
            return self.seen

    session = SimpleNamespace()
    session.read = Reader()
    seen = tables.read_jdbc(session, {"url": "jdbc:x"}, "legs", "id", "0", "100", 4)
    assert seen == {
        "format": "jdbc", "url": "jdbc:x", "dbtable": "legs", "partitionColumn": "id",
        "lowerBound": "0", "upperBound": "100", "numPartitions": 4,
    }
