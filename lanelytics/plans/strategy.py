"""Order-level revenue and cost strategies.

The rules for orders whose header row repeats what its sub-shipments carry
contradict each other, so each is a strategy of its own and none is the
default: row level (see ``plans.lanes``), smart, smart with a duplicate test,
by shipment type, hybrid, and the order headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanelytics.functions.labels import CITY_ARROW, lane_label
from lanelytics.functions.money import header_amount, is_crossdock, or_zero, sum_where
from lanelytics.functions.times import present
from lanelytics.operators.groups import lookup_join, semi_join
from lanelytics.operators.order_stats import ftl_structure, multidrop_orders
from lanelytics.operators.predicates import MARKETS, keys_present, same_market, standard_population

LTL = "Less Than Truckload"
FTL = "Full Truckload"

# Tolerances and multiples of the smart rules, in dollars and times.
REVENUE_MATCH = 1
COST_MATCH = 20
DUPLICATE_MATCH = 1
MAIN_DOMINATES = 2
SUB_DOMINATES = 5


def completed_of_type(legs: DataFrame, shipment_type: str = LTL) -> DataFrame:
    return legs.filter((F.col("shipmentStatus") == "Complete") & (F.col("shipmentType") == shipment_type))


def order_metrics(rows: DataFrame, lanes: bool = True) -> DataFrame:
    """Main, sub-shipment and handling sums per order, and its main row's lane.

    A maximum over lane text would turn the pass over all rows into a sort.  So
    rows are first hash aggregated per order and main lane, and the lane is
    picked among the few that an order has left.
    """
    main, sub = F.col("mainShipment") == "YES", F.col("mainShipment") == "NO"
    revenue, cost = F.col("revenueAllocationNumber"), F.col("costAllocationNumber")
    every = F.lit(True)
    sums = {
        "yes_rev": sum_where(main, revenue),
        "no_rev": sum_where(sub, revenue),
        "xd_leg_rev": sum_where(sub & is_crossdock(), revenue),
        "yes_cost": sum_where(main, cost),
        "no_cost": sum_where(sub, cost),
        "xd_no_cost": sum_where(sub & is_crossdock(), cost),
        "all_rev": sum_where(every, revenue),
        "all_cost": sum_where(every, cost),
        "order_rows": F.count(F.lit(1)),
        "main_rows": F.count(F.when(main, 1)),
        "sub_rows": F.count(F.when(sub, 1)),
    }
    named = [column.alias(name) for name, column in sums.items()]
    if not lanes:
        return rows.groupBy("orderCode").agg(*named)
    main_lane = [F.when(main, F.col(m)).alias(f"main_{m}") for m in MARKETS]
    return (
        rows.groupBy("orderCode", *main_lane)
        .agg(*named)
        .groupBy("orderCode")
        .agg(
            *[F.sum(name).alias(name) for name in sums],
            *[F.coalesce(F.max(f"main_{m}"), F.lit("NA")).alias(m) for m in MARKETS],
        )
    )


def smart_revenue_rule(variant: str = "additive") -> Column:
    """Which of the five revenue rules applies: 1 main only, 2 sub only,
    3 duplicates, 4 the main row dominates, 5 sub-shipments.

    The older ``main`` variant takes the main row alone under rule 4, and
    already at exactly twice the sub-shipments.
    """
    yes, no, handling = F.col("yes_rev"), F.col("no_rev"), F.col("xd_leg_rev")
    dominates = {"additive": yes > no * MAIN_DOMINATES, "main": yes >= no * MAIN_DOMINATES}[variant]
    return (
        F.when((yes > 0) & (no == 0), 1)
        .when(yes == 0, 2)
        .when(F.abs(no - handling - yes) < REVENUE_MATCH, 3)
        .when(dominates, 4)
        .otherwise(5)
    )


def smart_revenue(variant: str = "additive") -> Column:
    yes, no = F.col("yes_rev"), F.col("no_rev")
    rule = smart_revenue_rule(variant)
    both = yes + no if variant == "additive" else yes
    return F.when(rule == 1, yes).when(rule == 4, both).otherwise(no)


def smart_cost_rule(duplicate_test: bool) -> Column:
    """Which cost rule applies: 1 main only, 2 sub only, 3 similar amounts,
    4 sub-shipments dominate, 5 main plus handling.

    With the duplicate test rule 3 splits into ``3a`` for a sub-shipment that
    repeats the main cost and ``3b`` for amounts that merely add up to it.
    """
    yes, no = F.col("yes_cost"), F.col("no_cost")
    similar = F.lit("3")
    if duplicate_test:
        similar = F.when(F.col("has_matching_no_row"), F.lit("3a")).otherwise(F.lit("3b"))
    return (
        F.when((yes > 0) & (no == 0), F.lit("1"))
        .when((yes == 0) & (no > 0), F.lit("2"))
        .when(_similar_cost(), similar)
        .when(no > yes * SUB_DOMINATES, F.lit("4"))
        .otherwise(F.lit("5"))
    )


def _similar_cost() -> Column:
    return F.abs(F.col("no_cost") - F.col("xd_no_cost") - F.col("yes_cost")) < COST_MATCH


def smart_cost(rule: Column) -> Column:
    yes, no, handling = F.col("yes_cost"), F.col("no_cost"), F.col("xd_no_cost")
    return (
        F.when(rule.isin("1", "3a"), yes)
        .when(rule == "2", no)
        .when(rule.isin("3", "3b", "4"), yes + no)
        .otherwise(yes + handling)
    )


def with_duplicate_flag(metrics: DataFrame, rows: DataFrame) -> DataFrame:
    """Order metrics with ``has_matching_no_row``: one sub-shipment costs what the
    main rows cost together, within a dollar.

    Only orders whose amounts are similar need the test, so only they are
    compared with their sub-shipments.
    """
    candidates = metrics.filter(smart_cost_rule(duplicate_test=False) == "3").select("orderCode", "yes_cost")
    subs = rows.filter(F.col("mainShipment") == "NO").select("orderCode", "warpId", "costAllocationNumber")
    matching = (
        lookup_join(subs, candidates, "orderCode")
        .filter(F.abs(F.col("costAllocationNumber") - F.col("yes_cost")) < DUPLICATE_MATCH)
        .select("orderCode")
        .distinct()
        .withColumn("_match", F.lit(True))
    )
    return (
        metrics.join(matching, "orderCode", "left")
        .withColumn("has_matching_no_row", F.coalesce("_match", F.lit(False)))
        .drop("_match")
    )


def smart_orders(
    rows: DataFrame, variant: str = "additive", duplicate_test: bool = False, lanes: bool = True
) -> DataFrame:
    """Smart revenue and cost per order, with the rules that gave them."""
    metrics = order_metrics(rows, lanes)
    if duplicate_test:
        metrics = with_duplicate_flag(metrics, rows)
    return metrics.withColumns(
        {
            "revenue_rule": smart_revenue_rule(variant),
            "smart_revenue": smart_revenue(variant),
            "cost_rule": smart_cost_rule(duplicate_test),
            "smart_cost": smart_cost(smart_cost_rule(duplicate_test)),
        }
    )


def smart_same_market(rows: DataFrame, markets: tuple[str, ...] = (), variant: str = "additive") -> DataFrame:
    """Smart profit of lanes that stay within one market, worst first."""
    orders = smart_orders(rows, variant).filter(same_market())
    if markets:
        orders = orders.filter(F.col("startMarket").isin(*markets))
    return (
        orders.groupBy(*MARKETS)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("smart_revenue").alias("revenue"),
            F.sum("smart_cost").alias("cost"),
        )
        .select(
            lane_label(*MARKETS, arrow=CITY_ARROW).alias("lane"),
            "orders", "revenue", "cost",
            (F.col("revenue") - F.col("cost")).alias("profit"),
        )
        .orderBy("profit", "lane")
    )


def orders_by_type(legs: DataFrame) -> DataFrame:
    """Completed orders under the strategy of their shipment type.

    Full truckload sums all rows, less than truckload is smart with the
    duplicate test, anything else takes main rows.  An order with rows of
    several types is one result per type.
    """
    completed = legs.filter(F.col("shipmentStatus") == "Complete")
    ltl = smart_orders(
        completed.filter(F.col("shipmentType") == LTL), duplicate_test=True, lanes=False
    ).select(
        "orderCode",
        F.lit(LTL).alias("shipmentType"),
        F.col("smart_revenue").alias("revenue"),
        F.col("smart_cost").alias("cost"),
    )
    uses = (F.col("shipmentType") == FTL) | (F.col("mainShipment") == "YES")
    others = (
        completed.filter(F.col("shipmentType") != LTL)
        .groupBy("orderCode", "shipmentType")
        .agg(
            sum_where(uses, F.col("revenueAllocationNumber")).alias("revenue"),
            sum_where(uses, F.col("costAllocationNumber")).alias("cost"),
        )
    )
    return ltl.unionByName(others)


def profit_by_type(legs: DataFrame) -> DataFrame:
    """Totals of :func:`orders_by_type` per shipment type."""
    return (
        orders_by_type(legs)
        .groupBy("shipmentType")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue").alias("revenue"),
            F.sum("cost").alias("cost"),
        )
        .withColumn("profit", F.col("revenue") - F.col("cost"))
    )


def hybrid_orders(rows: DataFrame) -> DataFrame:
    """Sub-shipment revenue where there is any, else the main row's; all cost."""
    return order_metrics(rows).select(
        "orderCode",
        *MARKETS,
        F.when(F.col("no_rev") != 0, F.col("no_rev")).otherwise(F.col("yes_rev")).alias("revenue"),
        F.col("all_cost").alias("cost"),
    )


def revenue_pattern() -> Column:
    """Where an order carries its revenue."""
    yes, no = F.col("yes_rev") > 0, F.col("no_rev") > 0
    return (
        F.when(yes & no, F.lit("BOTH"))
        .when(yes, F.lit("YES_ONLY"))
        .when(no, F.lit("NO_ONLY"))
        .otherwise(F.lit("NONE"))
    )


def pattern_shares(rows: DataFrame) -> DataFrame:
    """Orders per revenue pattern, and their share of all orders in percent.

    The window spans the at most four patterns, not the orders.
    """
    counts = order_metrics(rows, lanes=False).groupBy(revenue_pattern().alias("pattern")).agg(F.count(F.lit(1)).alias("orders"))
    everything = F.sum("orders").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share_pct", F.col("orders") * 100 / everything).orderBy("pattern")


def structure_counts(legs: DataFrame) -> DataFrame:
    """Full-truckload orders per structure, with their rows and amounts."""
    rows = legs.filter(F.col("shipmentType") == FTL)
    orders = lookup_join(order_metrics(rows, lanes=False), multidrop_orders(rows), "orderCode")
    structure = ftl_structure(F.col("multidrop"), F.col("main_rows"), F.col("sub_rows"), F.col("order_rows"))
    return (
        orders.groupBy(structure.alias("structure"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("order_rows").alias("rows"),
            F.sum("all_rev").alias("revenue"),
            F.sum("all_cost").alias("cost"),
        )
        .orderBy("structure")
    )


def strategy_match(orders: DataFrame, headers: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """How often smart amounts are within a tolerance of the order headers.

    One row per measure and rule; orders without a header amount are left out,
    and counted by ``header_coverage``.
    """
    joined = orders.join(
        headers.select(
            F.col("code").alias("orderCode"),
            header_amount(F.col("revenueAllocation")).alias("header_revenue"),
            header_amount(F.col("costAllocation")).alias("header_cost"),
        ),
        "orderCode",
    )
    measures = F.explode(
        F.array(
            F.struct(
                F.lit("revenue").alias("measure"),
                F.col("revenue_rule").cast("string").alias("rule"),
                F.abs(F.col("smart_revenue") - F.col("header_revenue")).alias("gap"),
            ),
            F.struct(
                F.lit("cost").alias("measure"),
                F.col("cost_rule").alias("rule"),
                F.abs(F.col("smart_cost") - F.col("header_cost")).alias("gap"),
            ),
        )
    )
    return (
        joined.select(measures.alias("m"))
        .select("m.*")
        .filter(F.col("gap").isNotNull())
        .groupBy("measure", "rule")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count(F.when(F.col("gap") < F.lit(tolerance).cast("decimal(18,4)"), 1)).alias("matched"),
        )
        .withColumn("match_pct", F.col("matched") * 100 / F.col("orders"))
        .orderBy("measure", "rule")
    )


def header_coverage(orders: DataFrame, headers: DataFrame) -> DataFrame:
    """What becomes of the orders that are compared with their headers, per measure.

    Orders without a header, with a header that holds no amount, and with one
    whose text cannot be read are not compared; the rest are, in
    ``strategy_match`` by rule and in ``reconcile`` by sum.
    """
    amounts = {"revenue": "revenueAllocation", "cost": "costAllocation"}
    known = headers.select(F.col("code").alias("orderCode"), F.lit(True).alias("has_header"), *amounts.values())
    states = [
        F.struct(
            F.lit(measure).alias("measure"),
            F.when(F.col("has_header").isNull(), "no_header")
            .when(~F.coalesce(present(F.trim(column)), F.lit(False)), "missing")
            .when(header_amount(F.col(column)).isNull(), "unreadable")
            .otherwise("compared")
            .alias("state"),
        )
        for measure, column in amounts.items()
    ]
    listed = orders.join(known, "orderCode", "left").select(F.explode(F.array(*states)).alias("s")).select("s.*")
    states = ("no_header", "missing", "unreadable", "compared")
    counts = [F.count(F.when(F.col("state") == state, 1)).alias(state) for state in states]
    return listed.groupBy("measure").agg(F.count(F.lit(1)).alias("orders"), *counts).orderBy("measure")


def reconcile(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Main-only, sub-only and all-row totals against the order headers.

    Each side is totalled before they meet, over orders that are on both.
    """
    per_order = order_metrics(rows, lanes=False).join(
        headers.select(
            F.col("code").alias("orderCode"),
            header_amount(F.col("revenueAllocation")).alias("header_revenue"),
            header_amount(F.col("costAllocation")).alias("header_cost"),
        ),
        "orderCode",
    )
    totals = per_order.agg(
        *[F.sum(c).alias(c) for c in (
            "yes_rev", "no_rev", "all_rev", "header_revenue", "yes_cost", "no_cost", "all_cost", "header_cost",
        )]
    )
    approaches = F.explode(
        F.array(
            *[
                F.struct(F.lit(label).alias("approach"), F.col(rev).alias("revenue"), F.col(cost).alias("cost"))
                for label, rev, cost in (
                    ("main rows only", "yes_rev", "yes_cost"),
                    ("sub rows only", "no_rev", "no_cost"),
                    ("all rows", "all_rev", "all_cost"),
                )
            ]
        )
    )
    compared = totals.select(approaches.alias("a"), "header_revenue", "header_cost").select(
        "a.*", "header_revenue", "header_cost"
    )

    def gap(value: str, base: str) -> Column:
        whole = F.col(base).cast("double")
        return F.when(F.col(base) != 0, (F.col(value).cast("double") - whole) / whole * 100)

    return compared.withColumns(
        {"revenue_gap_pct": gap("revenue", "header_revenue"), "cost_gap_pct": gap("cost", "header_cost")}
    )


def cross_validation(legs: DataFrame, headers: DataFrame) -> DataFrame:
    """Each order's header revenue next to the sum over its legs."""
    sums = legs.groupBy("orderCode").agg(F.sum("revenueAllocationNumber").alias("leg_revenue"))
    return headers.select(
        F.col("code").alias("orderCode"), header_amount(F.col("revenueAllocation")).alias("header_revenue")
    ).join(sums, "orderCode")


def order_costs(rows: DataFrame) -> DataFrame:
    """Total cost per order id over all rows."""
    return rows.groupBy("orderId").agg(F.sum(or_zero(F.col("costAllocationNumber"))).alias("total_cost"))


def lane_costs(rows: DataFrame) -> DataFrame:
    """Total cost per known lane over all rows."""
    return (
        rows.filter(keys_present(*MARKETS))
        .groupBy(*MARKETS)
        .agg(F.sum(or_zero(F.col("costAllocationNumber"))).alias("lane_cost"))
    )


def tonu_orders(enriched: DataFrame) -> DataFrame:
    """Orders with a truck ordered but not used, and what those rows carry."""
    per_order = (
        enriched.filter(F.col("is_tonu"))
        .groupBy("orderCode")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(or_zero(F.col("revenueAllocationNumber"))).alias("revenue"),
            F.sum(or_zero(F.col("costAllocationNumber"))).alias("cost"),
        )
    )
    return per_order.agg(
        F.count("orderCode").alias("tonu_orders"),
        F.sum("rows").alias("tonu_rows"),
        F.sum("revenue").alias("tonu_revenue"),
        F.sum("cost").alias("tonu_cost"),
    )


def canceled_recognition(enriched: DataFrame) -> DataFrame:
    """Per shipment type: completed and canceled orders, and what counts of them.

    Trucks ordered but not used play no part here: only completed rows and
    canceled handling rows are recognized.
    """
    status = F.col("shipmentStatus")
    recognized = (status == "Complete") | ((status == "canceled") & F.col("is_crossdock"))

    per_order = (
        enriched.filter(standard_population())
        .groupBy("shipmentType", "orderCode")
        .agg(
            F.coalesce(F.max(status == "Complete"), F.lit(False)).alias("complete"),
            F.coalesce(F.max(status == "canceled"), F.lit(False)).alias("canceled"),
            sum_where(recognized, F.col("revenueAllocationNumber")).alias("revenue"),
            sum_where(recognized, F.col("costAllocationNumber")).alias("cost"),
        )
    )
    return per_order.groupBy("shipmentType").agg(
        F.count(F.when(F.col("complete"), F.col("orderCode"))).alias("completed_orders"),
        F.count(F.when(F.col("canceled"), F.col("orderCode"))).alias("canceled_orders"),
        F.sum("revenue").alias("revenue"),
        F.sum("cost").alias("cost"),
    )


def canceled_with_handling(legs: DataFrame) -> DataFrame:
    """Completed legs, and canceled ones whose order has a handling leg at any status."""
    handled = legs.filter(is_crossdock()).select("orderCode").distinct()
    canceled = semi_join(legs.filter(F.col("shipmentStatus") == "canceled"), handled, "orderCode")
    completed = legs.filter(F.col("shipmentStatus") == "Complete")
    return completed.unionByName(canceled)
