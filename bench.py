"""Time the headline reports and print one JSON line.

``landing`` derives and stores the raw freight tables from the test tables, which
users have already; ``enrich`` is the library's part, from raw to stored enriched
legs; the reports after it read the stored tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import sample  # noqa: E402
from checks.registry import REPORTS, Tables, plain  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = """
lane_profit lane_profit_ltl market_profit lane_diagnostics_all zip_diagnostics similar_mileage
lane_customers lane_carriers lane_order_details drill_headline_customer drill_detail_lane lane_list
order_metrics smart_revenue smart_cost_duplicate_test profit_by_type strategy_match source_reconciliation
canceled_with_handling carrier_otp customer_otd keep_flags order_row_counts rows_for_carrier_report bookings
lane_profit_from_headers lane_profit_from_legs legs_with_routes legs_on_routes shipment_links
allocation_profile distinct_lanes sanity_checks margin_summary weekly_change rolling_profit
""".split()


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "lanelytics-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # start the executors

    seconds: dict[str, float] = {}

    def timed(name: str, work) -> None:
        begun = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - begun, 3)

    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        raw = {name: f"{folder}/{name}" for name in sample.TABLES}
        enriched = f"{folder}/enriched"

        def land() -> None:
            for name, derive in sample.TABLES.items():
                derive(spark, sf_dir).write.parquet(raw[name])

        timed("landing", land)
        timed("enrich", lambda: sample.with_dates(spark.read.parquet(raw["legs"])).write.parquet(enriched))
        for name in HEADLINE:
            timed(name, lambda name=name: run(plain(REPORTS[name](Tables(spark, sf_dir, enriched, raw)))))

    print(
        json.dumps(
            {
                "metric": "headline reports, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
