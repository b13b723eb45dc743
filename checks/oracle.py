"""The same reports as SQL for DuckDB, written apart from the Spark plans.

Every statement starts from the test tables.  ``legs`` repeats the derivation
of the sample tables; ``e`` adds flags, counted money and parsed times.
"""

from __future__ import annotations

import datetime as dt

from checks.registry import (
    AS_OF,
    CUSTOMER,
    END,
    EQUIPMENT,
    EXCLUDED,
    LANE,
    MARKET_LANE,
    SOME_CUSTOMERS,
    SOME_LANES,
    START,
    ZIP_LANE,
)

_STAMP = "'%m/%d/%Y %H:%M:%S'"


def _at(days: int, hours: str) -> str:
    return f"strftime(l_shipdate + INTERVAL ({days}) DAY + to_hours(CAST({hours} AS BIGINT)), {_STAMP})"


_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_LEG_ID = f"'S-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || {_PRICE}"
_LOAD_ID = (
    "CASE WHEN l_orderkey % 10 = 6 THEN 'O-' || l_orderkey "
    "ELSE (l_partkey // 10) || '-' || strftime(l_shipdate, '%y%m') END"
)
_MAIN = """CASE WHEN l_linenumber = 7 AND l_quantity >= 50 THEN NULL
     WHEN l_linenumber <= 2 THEN 'YES' ELSE 'NO' END"""
_SAME = "WHEN l_orderkey % 10 = 4 THEN CASE WHEN l_linenumber IN (1, 3) THEN {} ELSE 0 END"
_REV = f"""CASE {_SAME.format(100)} WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 0
     ELSE CAST({_PRICE} * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) END"""
_COST = f"""CASE {_SAME.format(80)} WHEN l_quantity <> 3 THEN CAST({_PRICE}
     * (CAST(0.75 AS DECIMAL(4,2)) + CAST(4 AS DECIMAL(4,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) END"""
_KIND = """CASE WHEN o_orderkey % 10 <= 5 THEN 'Less Than Truckload' WHEN o_orderkey % 10 <= 7 THEN 'Full Truckload'
     WHEN o_orderkey % 10 = 8 THEN 'Parcel' ELSE 'LTL_CD' END"""

LEGS = f"""legs AS (
  SELECT 'P-' || o_orderkey AS orderCode, {_LEG_ID} AS warpId, {_LOAD_ID} AS loadId,
    CAST(o_orderkey AS VARCHAR) AS orderId, 'S-' || o_orderkey AS shipmentWarpId,
    CASE c_custkey % 50 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS clientName,
    CASE WHEN s_suppkey % 25 = 7 THEN NULL ELSE s_name END AS carrierName,
    'REP-' || s_suppkey % 7 AS carrierSaleRep,
    {_MAIN} AS mainShipment, {_KIND} AS shipmentType,
    CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'P' THEN 'canceled'
      ELSE CASE WHEN l_linestatus = 'O' THEN 'Pending' ELSE 'removed' END END AS shipmentStatus,
    CASE WHEN l_returnflag = 'R' AND l_tax >= 0.08 THEN 'TONU' END AS accessorialType,
    CASE l_partkey % 5 WHEN 0 THEN '53-ft Trailer' WHEN 1 THEN '26-ft Straight Truck /w Lift Gate'
      WHEN 2 THEN 'Cargo Van' WHEN 3 THEN '53-ft Reefer /w Team'
      ELSE 'Reefer Straight box truck /w Pallet Jack' END AS equipment,
    CASE l_partkey % 97 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE sn.n_name END AS startMarket,
    CASE l_partkey % 89 WHEN 0 THEN NULL ELSE cn.n_name END AS endMarket,
    'LOC-' || l_partkey % 20 AS pickLocationName, 'LOC-' || l_suppkey % 20 AS dropLocationName,
    'CITY-' || s_suppkey % 40 AS pickCity, 'CITY-' || c_custkey % 40 AS dropCity,
    CASE WHEN l_partkey % 83 = 0 THEN '' ELSE lpad(CAST(s_suppkey % 40 AS VARCHAR), 5, '0') END AS pickZipCode,
    lpad(CAST(c_custkey % 40 AS VARCHAR), 5, '0') AS dropZipCode,
    {_at(0, "8")} AS pickWindowFrom, {_at(0, "12")} AS pickWindowTo,
    CASE WHEN l_partkey % 11 <> 0 THEN {_at(0, "6 + l_quantity % 8")} END AS pickTimeArrived,
    {_at(3, "17")} AS dropWindowFrom, {_at(3, "20")} AS dropWindowTo,
    CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE {_at(3, "l_quantity % 24")} END AS dropTimeArrived,
    CASE WHEN l_partkey % 14 = 0 THEN '' ELSE strftime(l_shipdate + INTERVAL 3 DAY, '%m/%d/%Y') END
      AS dropDateArrived,
    CASE WHEN l_partkey % 3 = 0 THEN '' ELSE {_at(-2, "9")} END AS loadBookedTime,
    CASE WHEN l_linestatus = 'F' AND l_linenumber > 2 THEN 'Succeeded' END AS pickStatus,
    CASE WHEN l_linestatus = 'F' AND l_linenumber > 2 THEN 'Succeeded' END AS dropStatus,
    CASE WHEN l_partkey % 13 = 0 THEN 'Weather' ELSE '' END AS pickupDelayCode,
    CASE WHEN l_partkey % 17 = 0 THEN 'Traffic' ELSE '' END AS deliveryDelayCode,
    {_REV} AS rev, {_COST} AS cost, CAST({_PRICE} AS DECIMAL(18,4)) AS total,
    CASE WHEN l_partkey % 61 <> 0
      THEN CAST(abs(s_nationkey - c_nationkey) * 100 + l_linenumber AS DOUBLE) END AS shipmentMiles
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey)"""

_E = f"""e0 AS (
  SELECT *, pickLocationName = dropLocationName AS xd, accessorialType = 'TONU' AS tonu,
    startMarket || ' → ' || endMarket AS lane,
    try_strptime(pickTimeArrived, {_STAMP}) AS pick_at, try_strptime(pickWindowFrom, {_STAMP}) AS pick_from,
    try_strptime(pickWindowTo, {_STAMP}) AS pick_to, try_strptime(dropTimeArrived, {_STAMP}) AS drop_at,
    try_strptime(dropWindowFrom, {_STAMP}) AS drop_from, try_strptime(dropWindowTo, {_STAMP}) AS drop_to,
    coalesce(rev, 0) AS rev0, coalesce(cost, 0) AS cost0
  FROM legs), e AS (
  SELECT *,
    CASE WHEN xd THEN drop_from WHEN dropTimeArrived <> '' THEN drop_at
      WHEN dropDateArrived <> '' THEN try_strptime(dropDateArrived, '%m/%d/%Y') ELSE drop_from END AS delivered,
    CASE WHEN shipmentStatus = 'Complete' OR (shipmentStatus = 'canceled' AND xd) OR tonu
      THEN rev0 ELSE 0 END AS crev,
    CASE WHEN shipmentStatus = 'Complete' OR (shipmentStatus = 'canceled' AND xd) OR tonu
      THEN cost0 ELSE 0 END AS ccost
  FROM e0)"""

_HEADERS = f"""oh AS (
  SELECT 'P-' || o_orderkey AS code, c_name AS customerName,
    CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'P' THEN 'canceled' ELSE 'Pending' END AS status,
    {_KIND} AS shipmentType,
    CAST(CAST(CASE WHEN subs > 0 THEN sub_rev ELSE all_rev END AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS hrev,
    CAST(all_cost AS DECIMAL(18,2)) AS hcost, CAST(o_orderdate AS DATE) AS created
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (
    SELECT l_orderkey, count(*) FILTER (m = 'NO') AS subs, sum(coalesce(r, 0)) AS all_rev,
      coalesce(sum(coalesce(r, 0)) FILTER (m = 'NO'), 0) AS sub_rev, sum(coalesce(c, 0)) AS all_cost
    FROM (SELECT l_orderkey, {_MAIN} AS m, {_REV} AS r, {_COST} AS c
          FROM lineitem WHERE l_partkey % 20 <> l_suppkey % 20)
    GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""

_ROUTES = f"""routes AS (
  SELECT {_LOAD_ID} AS routeId, min(s_name) AS carrierName, list(DISTINCT {_LEG_ID}) AS codes
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{name}'" for name in names)


_POPULATION = "(shipmentStatus IN ('Complete', 'canceled') OR accessorialType = 'TONU')"
_DATES = f"delivered >= '{START}' AND delivered <= '{END}'"
_MARKETS = "startMarket <> '' AND endMarket <> ''"
_ZIPS = "pickZipCode <> '' AND dropZipCode <> ''"
_LTL = "shipmentType = 'Less Than Truckload' AND shipmentStatus = 'Complete'"
_NOT_EXCLUDED = f"clientName NOT IN ({_quoted(EXCLUDED)})"
_SINCE = f"{_LTL} AND try_strptime(dropDateArrived, '%m/%d/%Y') >= '1997-01-01'"
_MARKET_LANE = " AND ".join(f"{c} = '{v}'" for c, v in MARKET_LANE.items())
_ZIP_LANE = " AND ".join(f"{c} = '{v}'" for c, v in ZIP_LANE.items())
_WEEK = AS_OF - dt.timedelta(days=AS_OF.weekday() + 7)
_LAST_WEEK = f"drop_from >= '{_WEEK}' AND drop_from < '{_WEEK + dt.timedelta(days=7)}'"


def _last_month(moment: str) -> str:
    first = AS_OF.replace(day=1)
    return f"{moment} >= DATE '{first}' - INTERVAL 1 MONTH AND {moment} < DATE '{first}'"


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((LEGS, _E, *ctes)) + "\n" + body


def _num(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 ELSE 0 END"


def _measures(where: str, keys: str = "", extra: str = "") -> str:
    """The profit measures per key, as CTE ``m`` with exact money."""
    return f"""m AS (
  SELECT {keys + ", " if keys else ""}
    count(DISTINCT CASE WHEN shipmentStatus = 'Complete' THEN orderCode END) AS completed_orders,
    count(DISTINCT CASE WHEN shipmentStatus = 'canceled' THEN orderCode END) AS canceled_orders,
    count(DISTINCT orderCode) AS orders, count(DISTINCT warpId) AS shipments,
    sum(crev) AS total_revenue, sum(ccost) AS total_cost, sum(crev) - sum(ccost) AS total_profit,
    sum(CASE WHEN xd THEN cost0 ELSE 0 END) AS crossdock_cost,
    sum(CASE WHEN tonu THEN rev0 ELSE 0 END) AS tonu_revenue,
    sum(CASE WHEN tonu THEN cost0 ELSE 0 END) AS tonu_cost,
    count(*) FILTER (tonu) AS tonu_rows,
    avg(CASE WHEN mainShipment = 'YES' THEN coalesce(shipmentMiles, 0) END) AS miles{extra}
  FROM e WHERE {where} {"GROUP BY " + keys if keys else ""})"""


_STANDARD = f"{_POPULATION} AND {_DATES}"
_LANE_KEYS = "startMarket, endMarket"
_ZIP_KEYS = "pickZipCode, dropZipCode"
_LANE_NAME = "startMarket || ' → ' || endMarket"
_MONEY = _num("total_revenue", "total_cost", "total_profit", "crossdock_cost", "tonu_revenue", "tonu_cost")
_MARGIN = _pct("total_profit", "total_revenue")
_XD_PCT = _pct("crossdock_cost", "total_cost")


def _lane_profit(where: str = _STANDARD) -> str:
    return _with(
        f"""SELECT {_LANE_NAME} AS lane, startMarket, endMarket, completed_orders, canceled_orders,
  completed_orders + canceled_orders AS total_orders, {_MONEY},
  round_even({_XD_PCT}, 1) + 0.0 AS crossdock_cost_pct, round_even({_MARGIN}, 1) + 0.0 AS margin_pct
FROM m WHERE completed_orders > 0 OR canceled_orders > 0 OR tonu_rows > 0""",
        _measures(f"{where} AND {_MARKETS}", _LANE_KEYS),
    )


def _market(where: str = _STANDARD) -> str:
    return _with(
        f"""SELECT startMarket AS market, completed_orders, canceled_orders, {_MONEY}, {_MARGIN} AS margin_pct FROM m""",
        _measures(f"{where} AND startMarket = endMarket AND startMarket <> ''", "startMarket"),
    )


def _diagnostics(where: str, min_orders: int = 5, only_negative: bool = True) -> str:
    having = f"orders >= {min_orders}" + (" AND total_profit < 0" if only_negative else "")
    return _with(
        f"""SELECT {_LANE_NAME} AS lane, startMarket, endMarket, completed_orders, canceled_orders,
  round(miles, 0) AS avg_miles, {_MONEY}, {_MARGIN} AS margin_pct, {_XD_PCT} AS xd_cost_pct
FROM m WHERE {having}""",
        _measures(f"{where} AND {_MARKETS}", _LANE_KEYS),
    )


def _zip_diagnostics(where: str, min_orders: int = 5, only_negative: bool = True) -> str:
    having = f"orders >= {min_orders}" + (" AND total_profit < 0" if only_negative else "")
    return _with(
        f"""SELECT pickZipCode || ' → ' || dropZipCode AS lane,
  pickZipCode || ' → ' || dropZipCode || ' (' || pickCity || ' → ' || dropCity || ')' AS lane_display,
  pickZipCode, dropZipCode, pickCity, dropCity, startMarket, endMarket, completed_orders, canceled_orders,
  round(miles, 0) AS avg_miles, {_MONEY}, {_MARGIN} AS margin_pct, {_XD_PCT} AS xd_cost_pct
FROM m WHERE {having}""",
        _measures(
            f"{where} AND {_ZIPS}",
            _ZIP_KEYS,
            """, max(pickCity) AS pickCity, max(dropCity) AS dropCity,
    max(startMarket) AS startMarket, max(endMarket) AS endMarket""",
        ),
    )


def _headline(where: str, keys: str, having: str) -> str:
    totals = "total_revenue", "total_cost", "total_profit", "crossdock_cost", "tonu_revenue", "tonu_cost"
    return _with(
        f"""SELECT lanes_shown, negative_lanes, CAST(total_loss AS DOUBLE) AS total_loss, completed_orders,
  canceled_orders, completed_affected, canceled_affected, {_MONEY}, {_XD_PCT} AS crossdock_cost_pct,
  {_pct("tonu_cost", "total_cost")} AS tonu_cost_pct, CAST(tonu_revenue - tonu_cost AS DOUBLE) AS tonu_profit
FROM (SELECT count(*) AS lanes_shown, count(*) FILTER (total_profit < 0) AS negative_lanes,
    coalesce(sum(total_profit) FILTER (total_profit < 0), 0) AS total_loss,
    CAST(sum(completed_orders) AS BIGINT) AS completed_orders, CAST(sum(canceled_orders) AS BIGINT) AS canceled_orders,
    CAST(coalesce(sum(completed_orders) FILTER (total_profit < 0), 0) AS BIGINT) AS completed_affected,
    CAST(coalesce(sum(canceled_orders) FILTER (total_profit < 0), 0) AS BIGINT) AS canceled_affected,
    {", ".join(f"sum({t}) AS {t}" for t in totals)}
  FROM m WHERE {having})""",
        _measures(where, keys),
    )


def _peers(target: str) -> str:
    return f"""peers AS (
  SELECT {_LANE_NAME} AS lane, startMarket, endMarket, completed_orders, canceled_orders,
    round(miles, 0) AS avg_miles, total_revenue, total_cost, crossdock_cost, total_profit AS profit,
    {_MARGIN} AS margin_pct, {_XD_PCT} AS xd_cost_pct, shipments / orders AS avg_legs, tonu_revenue, tonu_cost
  FROM m WHERE miles BETWEEN {target} * (1 - 0.2::DOUBLE) AND {target} * (1 + 0.2::DOUBLE) AND orders >= 3)"""


_PEER_COLUMNS = "lane, startMarket, endMarket, completed_orders, canceled_orders, avg_miles, " + (
    _num("total_revenue", "total_cost", "crossdock_cost", "profit", "tonu_revenue", "tonu_cost")
    + ", margin_pct, xd_cost_pct, avg_legs"
)
_TARGET = f"(SELECT round(miles, 0) FROM m WHERE {_LANE_NAME} = '{LANE}')"


def _customers(lane: str, known: str) -> str:
    return _with(
        f"""SELECT clientName AS customer, completed_orders, canceled_orders,
  {_num("total_revenue", "total_cost", "total_profit", "tonu_revenue", "tonu_cost")}, {_MARGIN} AS margin_pct,
  CASE WHEN completed_orders + canceled_orders > 0
    THEN CAST(total_profit AS DOUBLE) / (completed_orders + canceled_orders) ELSE 0 END AS avg_profit_per_order
FROM m""",
        _measures(f"{_STANDARD} AND {known} AND {lane}", "clientName"),
    )


def _carrier_body(lane: str, known: str) -> str:
    return _measures(f"{_STANDARD} AND {known} AND {lane} AND carrierName <> ''", "carrierName")


def _carriers(lane: str, known: str) -> str:
    return _with(
        f"""SELECT carrierName AS carrier, orders AS orders_with_carrier, shipments AS shipment_count,
  {_num("total_cost", "total_revenue", "total_profit")},
  CAST(total_profit AS DOUBLE) / shipments AS avg_profit_per_shipment FROM m""",
        _carrier_body(lane, known),
    )


def _extremes(lane: str, known: str) -> str:
    return _with(
        """SELECT count(*) AS total_carriers,
  first(carrierName ORDER BY orders DESC, total_profit, carrierName) AS most_used, max(orders) AS most_used_orders,
  first(carrierName ORDER BY total_profit, carrierName) AS worst_profit_carrier,
  CAST(min(total_profit) AS DOUBLE) AS worst_profit,
  first(carrierName ORDER BY per, total_profit, carrierName) AS worst_avg_carrier, min(per) AS worst_avg_profit
FROM (SELECT *, CAST(total_profit AS DOUBLE) / shipments AS per FROM m)""",
        _carrier_body(lane, known),
    )


def _details(lane: str, known: str, places: str = "") -> str:
    return _with(
        f"""SELECT orderCode, warpId, clientName AS customer, shipmentStatus, mainShipment, pickLocationName,
  dropLocationName, {places} startMarket, endMarket, dropWindowFrom AS scheduled_delivery,
  coalesce(dropTimeArrived, dropDateArrived) AS actual_delivery, carrierName AS carrier, accessorialType,
  CAST(crev AS DOUBLE) AS revenue, CAST(ccost AS DOUBLE) AS cost,
  CASE WHEN tonu THEN 'Yes' ELSE 'No' END AS is_tonu, CASE WHEN xd THEN 'Yes' ELSE 'No' END AS is_crossdock
FROM e WHERE {_STANDARD} AND {known} AND {lane}"""
    )


def _drill_headline(where: str) -> str:
    return _with(
        f"""SELECT completed_orders, canceled_orders, {_MONEY}, {_XD_PCT} AS crossdock_cost_pct,
  {_pct("tonu_cost", "total_cost")} AS tonu_cost_pct FROM m""",
        _measures(f"{_STANDARD} AND {where}"),
    )


_LISTED = """shipmentStatus <> 'removed' AND (shipmentType IN ('Full Truckload', 'Less Than Truckload')
  OR (shipmentType = 'Parcel' AND mainShipment = 'YES'))"""


def _drill_detail(where: str, limit: str = "") -> str:
    return _with(
        f"""SELECT orderCode AS "Order ID", warpId AS "Warp ID", mainShipment AS "Main Shipment", lane AS "Lane",
  clientName AS "Customer", carrierName AS "Carrier", pickLocationName AS "Pickup Location",
  dropLocationName AS "Drop Location", CAST(rev0 AS DOUBLE) AS "Revenue", CAST(cost0 AS DOUBLE) AS "Cost",
  CAST(rev0 - cost0 AS DOUBLE) AS "Profit", CASE WHEN xd THEN 'Yes' ELSE 'No' END AS "Cross-dock",
  shipmentType AS "Shipment Type", pickWindowFrom AS "Pickup Window"
FROM e WHERE {_DATES} AND {_LISTED} AND {where}
ORDER BY orderCode NULLS FIRST, mainShipment DESC NULLS LAST, warpId {limit}"""
    )


def _allocation(where: str, start: str, end: str) -> str:
    return _with(
        f"""SELECT startMarket, endMarket, {_LANE_NAME} AS lane, CAST(r AS DOUBLE) AS lane_revenue,
  CAST(c AS DOUBLE) AS lane_cost, CAST(r - c AS DOUBLE) AS lane_profit
FROM (SELECT {start} AS startMarket, {end} AS endMarket, sum(crev) AS r, sum(ccost) AS c
  FROM e WHERE {where} GROUP BY ALL)"""
    )


LANES = {
    "lane_profit": _lane_profit(),
    "lane_profit_ftl": _lane_profit(f"{_STANDARD} AND shipmentType = 'Full Truckload'"),
    "lane_profit_ltl": _lane_profit(f"{_STANDARD} AND shipmentType = 'Less Than Truckload'"),
    "lane_profit_parcel": _lane_profit(f"{_STANDARD} AND shipmentType = 'Parcel'"),
    "lane_profit_chosen": _lane_profit(
        f"{_STANDARD} AND clientName IN ({_quoted(SOME_CUSTOMERS)}) AND lane IN ({_quoted(SOME_LANES)})"
    ),
    "lane_profit_whole_end_day": _lane_profit(f"{_POPULATION} AND delivered >= '{START}' AND delivered < '1999-01-01'"),
    "lane_profit_last_days": _lane_profit(f"{_POPULATION} AND delivered >= '1998-05-18' AND delivered <= '1998-06-17'"),
    "lane_profit_headline": _headline(
        f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS, "completed_orders > 0 OR canceled_orders > 0 OR tonu_rows > 0"
    ),
    "lane_allocation": _allocation(f"{_POPULATION} AND {_MARKETS}", "startMarket", "endMarket"),
    "lane_allocation_with_na": _allocation(
        _POPULATION, "coalesce(startMarket, 'NA')", "coalesce(endMarket, 'NA')"
    ),
    "market_profit": _market(),
    "market_profit_excluding": _market(f"{_STANDARD} AND {_NOT_EXCLUDED}"),
    "market_profit_without_crossdock": _market(f"{_STANDARD} AND xd IS DISTINCT FROM true"),
    "market_profit_headline": _headline(
        f"{_STANDARD} AND startMarket = endMarket AND startMarket <> ''", "startMarket", "true"
    ),
    "lane_diagnostics": _diagnostics(f"{_STANDARD} AND shipmentType = 'Less Than Truckload'"),
    "lane_diagnostics_all": _diagnostics(_STANDARD, 1, False),
    "lane_diagnostics_excluding": _diagnostics(f"{_STANDARD} AND {_NOT_EXCLUDED}"),
    "lane_diagnostics_headline": _headline(
        f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS, "orders >= 5 AND total_profit < 0"
    ),
    "lanes_named_na": _with(
        f"""SELECT count(*) AS na_lanes FROM m WHERE orders >= 5 AND total_profit < 0
  AND contains({_LANE_NAME}, 'NA')""",
        _measures(f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS),
    ),
    "zip_diagnostics": _zip_diagnostics(_STANDARD),
    "zip_diagnostics_all": _zip_diagnostics(f"{_STANDARD} AND shipmentType = 'Less Than Truckload'", 1, False),
    "zip_diagnostics_headline": _headline(f"{_STANDARD} AND {_ZIPS}", _ZIP_KEYS, "orders >= 5 AND total_profit < 0"),
    "similar_mileage": _with(
        f"SELECT {_PEER_COLUMNS} FROM peers", _measures(f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS), _peers(_TARGET)
    ),
    "similar_mileage_tagged": _with(
        f"""SELECT {_PEER_COLUMNS},
  CASE WHEN lane = '{LANE}' THEN 'Selected' ELSE 'Similar Mileage' END AS comparison_type FROM peers""",
        _measures(f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS),
        _peers("900::DOUBLE"),
    ),
    "peer_comparison": _with(
        f"""SELECT s AS selected_profit, n AS peer_lanes, p AS peer_avg_profit, s - p AS difference,
  CASE WHEN p <> 0 THEN (s - p) / abs(p) * 100 ELSE 0 END AS difference_pct
FROM (SELECT CAST(max(profit) FILTER (lane = '{LANE}') AS DOUBLE) AS s, count(*) FILTER (lane <> '{LANE}') AS n,
    CAST(sum(profit) FILTER (lane <> '{LANE}') AS DOUBLE) / count(*) FILTER (lane <> '{LANE}') AS p FROM peers)
WHERE s IS NOT NULL AND n > 0""",
        _measures(f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS),
        _peers(_TARGET),
    ),
    "lane_customers": _customers(_MARKET_LANE, _MARKETS),
    "zip_customers": _customers(_ZIP_LANE, _ZIPS),
    "lane_carriers": _carriers(_MARKET_LANE, _MARKETS),
    "zip_carriers": _carriers(_ZIP_LANE, _ZIPS),
    "lane_carrier_extremes": _extremes(_MARKET_LANE, _MARKETS),
    "zip_carrier_extremes": _extremes(_ZIP_LANE, _ZIPS),
    "lane_order_details": _details(_MARKET_LANE, _MARKETS),
    "zip_order_details": _details(_ZIP_LANE, _ZIPS, "pickZipCode, dropZipCode, pickCity, dropCity,"),
    "drill_headline_customer": _drill_headline(f"clientName = '{CUSTOMER}'"),
    "drill_headline_lane": _drill_headline(f"shipmentType = 'Less Than Truckload' AND {_MARKET_LANE}"),
    "drill_headline_unsplittable": _drill_headline("true"),
    "drill_detail_customer": _drill_detail(f"clientName = '{CUSTOMER}'"),
    "drill_detail_lane": _drill_detail(f"lane = '{LANE}'"),
    "drill_detail_lane_short": _drill_detail(f"lane = '{LANE}'", "LIMIT 5"),
    "drill_detail_whole": _drill_detail("true"),
    "drill_detail_in_order": f"""SELECT *, CAST(row_number() OVER (ORDER BY "Order ID" NULLS FIRST, "Main Shipment" DESC NULLS LAST,
  "Warp ID") AS BIGINT) AS place FROM ({_drill_detail(f"lane = '{LANE}'")})""",
    "lane_profit_in_order": f"""SELECT *, CAST(row_number() OVER (ORDER BY total_profit DESC, lane) AS BIGINT) AS place
FROM ({_lane_profit()})""",
    "similar_mileage_in_order": f"""SELECT *, CAST(row_number() OVER (ORDER BY profit, lane) AS BIGINT) AS place FROM ({_with(
        f"SELECT {_PEER_COLUMNS} FROM peers", _measures(f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS), _peers("900::DOUBLE")
    )})""",
    "similar_mileage_tagged_in_order": f"""SELECT *, CAST(row_number() OVER (ORDER BY lane <> '{LANE}', profit, lane) AS BIGINT) AS place
FROM ({_with(
        f"""SELECT {_PEER_COLUMNS},
  CASE WHEN lane = '{LANE}' THEN 'Selected' ELSE 'Similar Mileage' END AS comparison_type FROM peers""",
        _measures(f"{_STANDARD} AND {_MARKETS}", _LANE_KEYS), _peers("900::DOUBLE")
    )})""",
    "lane_profit_from_states": _lane_profit(),
    "lane_profit_from_states_days": _lane_profit(f"{_POPULATION} AND delivered >= '1998-05-18' AND delivered <= '1998-06-17'"),
    "lane_profit_from_states_ltl": _lane_profit(f"{_STANDARD} AND shipmentType = 'Less Than Truckload'"),
    "market_profit_from_states": _market(),
    "drill_detail_parcel_whole": _drill_detail("shipmentType = 'Parcel'"),
    "drill_detail_totals": _with(
        f"""SELECT count(DISTINCT orderCode) AS completed_orders, count(*) AS total_rows,
  CAST(sum(rev0) AS DOUBLE) AS total_revenue, CAST(sum(cost0) AS DOUBLE) AS total_cost,
  CAST(sum(rev0 - cost0) AS DOUBLE) AS total_profit,
  CAST(sum(CASE WHEN xd THEN cost0 ELSE 0 END) AS DOUBLE) AS crossdock_cost
FROM e WHERE {_DATES} AND {_LISTED} AND lane = '{LANE}'"""
    ),
    "customer_list": _with(
        "SELECT DISTINCT clientName FROM e WHERE clientName <> '' ORDER BY clientName"
    ),
    "customer_list_short": _with(
        "SELECT DISTINCT clientName FROM e WHERE clientName <> '' ORDER BY clientName LIMIT 20"
    ),
    "lane_list": _with(f"SELECT DISTINCT lane FROM e WHERE {_MARKETS} ORDER BY lane"),
    "lane_list_of_customer": _with(
        f"SELECT DISTINCT lane FROM e WHERE {_MARKETS} AND clientName = '{CUSTOMER}' ORDER BY lane"
    ),
    "lane_profit_sql": _with(
        """SELECT lane, count(*) AS legs, CAST(sum(crev - ccost) AS DOUBLE) AS profit FROM e
WHERE shipmentType = 'Full Truckload' AND lane IS NOT NULL GROUP BY lane"""
    ),
}

# ---------------------------------------------------------------- order-level strategies


def _orders(where: str = _LTL) -> str:
    return f"""om AS (
  SELECT orderCode,
    sum(CASE WHEN mainShipment = 'YES' THEN rev0 ELSE 0 END) AS yes_rev,
    sum(CASE WHEN mainShipment = 'NO' THEN rev0 ELSE 0 END) AS no_rev,
    sum(CASE WHEN mainShipment = 'NO' AND xd THEN rev0 ELSE 0 END) AS xd_leg_rev,
    sum(CASE WHEN mainShipment = 'YES' THEN cost0 ELSE 0 END) AS yes_cost,
    sum(CASE WHEN mainShipment = 'NO' THEN cost0 ELSE 0 END) AS no_cost,
    sum(CASE WHEN mainShipment = 'NO' AND xd THEN cost0 ELSE 0 END) AS xd_no_cost,
    sum(rev0) AS all_rev, sum(cost0) AS all_cost, count(*) AS order_rows,
    count(*) FILTER (mainShipment = 'YES') AS main_rows, count(*) FILTER (mainShipment = 'NO') AS sub_rows,
    coalesce(max(startMarket) FILTER (mainShipment = 'YES'), 'NA') AS startMarket,
    coalesce(max(endMarket) FILTER (mainShipment = 'YES'), 'NA') AS endMarket
  FROM e WHERE {where} GROUP BY orderCode), dup AS (
  SELECT e.orderCode, bool_or(e.mainShipment = 'NO' AND abs(e.cost - om.yes_cost) < 1) AS hit
  FROM e JOIN om USING (orderCode) WHERE {where} GROUP BY e.orderCode), so AS (
  SELECT om.*,
    CASE WHEN yes_rev > 0 AND no_rev = 0 THEN 1 WHEN yes_rev = 0 THEN 2
      WHEN abs(no_rev - xd_leg_rev - yes_rev) < 1 THEN 3 WHEN yes_rev > 2 * no_rev THEN 4 ELSE 5 END AS rr,
    CASE WHEN yes_rev > 0 AND no_rev = 0 THEN 1 WHEN yes_rev = 0 THEN 2
      WHEN abs(no_rev - xd_leg_rev - yes_rev) < 1 THEN 3 WHEN yes_rev >= 2 * no_rev THEN 4 ELSE 5 END AS rr_old,
    CASE WHEN yes_cost > 0 AND no_cost = 0 THEN '1' WHEN yes_cost = 0 AND no_cost > 0 THEN '2'
      WHEN abs(no_cost - xd_no_cost - yes_cost) < 20 THEN '3' WHEN no_cost > 5 * yes_cost THEN '4'
      ELSE '5' END AS cr, coalesce(hit, false) AS hit
  FROM om LEFT JOIN dup USING (orderCode)), sm AS (
  SELECT *, CASE rr WHEN 1 THEN yes_rev WHEN 4 THEN yes_rev + no_rev ELSE no_rev END AS smart_revenue,
    CASE WHEN rr_old IN (1, 4) THEN yes_rev ELSE no_rev END AS old_revenue,
    CASE cr WHEN '1' THEN yes_cost WHEN '2' THEN no_cost WHEN '5' THEN yes_cost + xd_no_cost
      ELSE yes_cost + no_cost END AS smart_cost,
    CASE WHEN cr = '3' THEN CASE WHEN hit THEN '3a' ELSE '3b' END ELSE cr END AS cr3,
    CASE WHEN cr = '1' OR (cr = '3' AND hit) THEN yes_cost WHEN cr = '2' THEN no_cost
      WHEN cr = '5' THEN yes_cost + xd_no_cost ELSE yes_cost + no_cost END AS v3_cost
  FROM so)"""


_GAP = """CASE WHEN {b} <> 0 THEN (CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) / CAST({b} AS DOUBLE) * 100 END"""


def _same_market(where: str) -> str:
    return _with(
        f"""SELECT startMarket || ' -> ' || endMarket AS lane, count(*) AS orders,
  CAST(sum(smart_revenue) AS DOUBLE) AS revenue, CAST(sum(smart_cost) AS DOUBLE) AS cost,
  CAST(sum(smart_revenue) - sum(smart_cost) AS DOUBLE) AS profit
FROM sm WHERE startMarket = endMarket AND {where} GROUP BY startMarket, endMarket""",
        _orders(),
    )


STRATEGIES = {
    "order_metrics": _with(
        f"""SELECT orderCode, startMarket, endMarket, order_rows, main_rows, sub_rows,
  {_num("yes_rev", "no_rev", "xd_leg_rev", "yes_cost", "no_cost", "xd_no_cost", "all_rev", "all_cost")} FROM om""",
        _orders(),
    ),
    "smart_revenue": _with(
        "SELECT orderCode, CAST(rr AS BIGINT) AS revenue_rule, CAST(smart_revenue AS DOUBLE) AS smart_revenue FROM sm",
        _orders(),
    ),
    "smart_revenue_older": _with(
        "SELECT orderCode, CAST(rr_old AS BIGINT) AS revenue_rule, CAST(old_revenue AS DOUBLE) AS smart_revenue FROM sm",
        _orders(),
    ),
    "smart_cost": _with(
        "SELECT orderCode, cr AS cost_rule, CAST(smart_cost AS DOUBLE) AS smart_cost FROM sm", _orders()
    ),
    "smart_cost_duplicate_test": _with(
        "SELECT orderCode, cr3 AS cost_rule, CAST(v3_cost AS DOUBLE) AS smart_cost FROM sm", _orders()
    ),
    "smart_same_market": _same_market("startMarket IN ('NATION_1', 'NATION_2', 'NATION_3')"),
    "smart_same_market_all": _same_market("true"),
    "profit_by_type": _with(
        """SELECT shipmentType, count(*) AS orders, CAST(sum(r) AS DOUBLE) AS revenue, CAST(sum(c) AS DOUBLE) AS cost,
  CAST(sum(r) - sum(c) AS DOUBLE) AS profit
FROM (SELECT 'Less Than Truckload' AS shipmentType, smart_revenue AS r, v3_cost AS c FROM sm
  UNION ALL
  SELECT shipmentType, sum(CASE WHEN shipmentType = 'Full Truckload' OR mainShipment = 'YES' THEN rev0 ELSE 0 END),
    sum(CASE WHEN shipmentType = 'Full Truckload' OR mainShipment = 'YES' THEN cost0 ELSE 0 END)
  FROM e WHERE shipmentStatus = 'Complete' AND shipmentType <> 'Less Than Truckload'
  GROUP BY shipmentType, orderCode)
GROUP BY shipmentType""",
        _orders(),
    ),
    "hybrid_orders": _with(
        """SELECT orderCode, startMarket, endMarket,
  CAST(CASE WHEN no_rev <> 0 THEN no_rev ELSE yes_rev END AS DOUBLE) AS revenue, CAST(all_cost AS DOUBLE) AS cost
FROM om""",
        _orders(),
    ),
    "revenue_patterns": _with(
        """SELECT pattern, count(*) AS orders, count(*) * 100 / (SELECT count(*) FROM om) AS share_pct
FROM (SELECT CASE WHEN yes_rev > 0 AND no_rev > 0 THEN 'BOTH' WHEN yes_rev > 0 THEN 'YES_ONLY'
    WHEN no_rev > 0 THEN 'NO_ONLY' ELSE 'NONE' END AS pattern FROM om) GROUP BY pattern""",
        _orders(),
    ),
    "ftl_structures": _with(
        """SELECT structure, count(*) AS orders, CAST(sum(order_rows) AS BIGINT) AS rows,
  CAST(sum(all_rev) AS DOUBLE) AS revenue, CAST(sum(all_cost) AS DOUBLE) AS cost
FROM (SELECT *, CASE WHEN main_rows = 1 AND order_rows = 1 THEN 'direct'
    WHEN orderCode IN (SELECT orderCode FROM e WHERE mainShipment = 'YES' AND shipmentType = 'Full Truckload'
      GROUP BY orderCode, loadId HAVING count(*) > 1) THEN 'multidrop'
    WHEN main_rows = 1 AND sub_rows > 0 THEN 'multistop' ELSE 'other' END AS structure FROM om)
GROUP BY structure""",
        _orders("shipmentType = 'Full Truckload'"),
    ),
    "strategy_match": _with(
        """SELECT measure, rule, count(*) AS orders, count(*) FILTER (gap < 20) AS matched,
  count(*) FILTER (gap < 20) * 100 / count(*) AS match_pct
FROM (SELECT 'revenue' AS measure, CAST(rr AS VARCHAR) AS rule, abs(smart_revenue - hrev) AS gap
  FROM sm JOIN oh ON orderCode = code
  UNION ALL SELECT 'cost', cr3, abs(v3_cost - hcost) FROM sm JOIN oh ON orderCode = code)
WHERE gap IS NOT NULL GROUP BY measure, rule""",
        _orders(),
        _HEADERS,
    ),
    "header_coverage": _with(
        f"""SELECT measure, count(*) AS orders, count(*) FILTER (n % 11 = 5) AS no_header,
  count(*) FILTER (n % 11 <> 5 AND (r IN (1, 3) OR r > 3 AND amount IS NULL)) AS missing,
  count(*) FILTER (n % 11 <> 5 AND r IN (0, 2)) AS unreadable,
  count(*) FILTER (n % 11 <> 5 AND r > 3 AND amount IS NOT NULL) AS compared
FROM (
  SELECT 'revenue' AS measure, n, n % 9 AS r, hrev AS amount FROM o JOIN oh USING (code)
  UNION ALL SELECT 'cost', n, (n + 4) % 9, hcost FROM o JOIN oh USING (code)
) GROUP BY measure""",
        _HEADERS,
        f"o AS (SELECT DISTINCT orderCode AS code, CAST(substr(orderCode, 3) AS BIGINT) AS n FROM e WHERE {_LTL})",
    ),
    "source_reconciliation": _with(
        f"""SELECT approach, CAST(r AS DOUBLE) AS revenue, CAST(c AS DOUBLE) AS cost,
  CAST(hr AS DOUBLE) AS header_revenue, CAST(hc AS DOUBLE) AS header_cost,
  {_GAP.format(a="r", b="hr")} AS revenue_gap_pct, {_GAP.format(a="c", b="hc")} AS cost_gap_pct
FROM (SELECT unnest(['main rows only', 'sub rows only', 'all rows']) AS approach,
    unnest([sum(yes_rev), sum(no_rev), sum(all_rev)]) AS r, unnest([sum(yes_cost), sum(no_cost), sum(all_cost)]) AS c,
    sum(hrev) AS hr, sum(hcost) AS hc FROM om JOIN oh ON orderCode = code)""",
        _orders(),
        _HEADERS,
    ),
    "cross_validation": _with(
        """SELECT code AS orderCode, CAST(hrev AS DOUBLE) AS header_revenue, CAST(sum(rev) AS DOUBLE) AS leg_revenue
FROM oh JOIN e ON code = orderCode GROUP BY code, hrev""",
        _HEADERS,
    ),
    "order_costs": _with(f"SELECT orderId, CAST(sum(cost0) AS DOUBLE) AS total_cost FROM e WHERE {_LTL} GROUP BY orderId"),
    "lane_costs": _with(
        f"""SELECT startMarket, endMarket, CAST(sum(cost0) AS DOUBLE) AS lane_cost
FROM e WHERE {_LTL} AND {_MARKETS} GROUP BY startMarket, endMarket"""
    ),
    "tonu_orders": _with(
        """SELECT count(DISTINCT orderCode) AS tonu_orders, count(*) AS tonu_rows,
  CAST(sum(rev0) AS DOUBLE) AS tonu_revenue, CAST(sum(cost0) AS DOUBLE) AS tonu_cost FROM e WHERE tonu"""
    ),
    "canceled_recognition": _with(
        f"""SELECT shipmentType, count(DISTINCT orderCode) FILTER (shipmentStatus = 'Complete') AS completed_orders,
  count(DISTINCT orderCode) FILTER (shipmentStatus = 'canceled') AS canceled_orders,
  CAST(sum(CASE WHEN shipmentStatus = 'Complete' OR (shipmentStatus = 'canceled' AND xd) THEN rev0 ELSE 0 END)
    AS DOUBLE) AS revenue,
  CAST(sum(CASE WHEN shipmentStatus = 'Complete' OR (shipmentStatus = 'canceled' AND xd) THEN cost0 ELSE 0 END)
    AS DOUBLE) AS cost
FROM e WHERE {_POPULATION} GROUP BY shipmentType"""
    ),
    "canceled_with_handling": _with(
        """SELECT orderCode, warpId, shipmentStatus FROM e a WHERE shipmentStatus = 'Complete' OR (
  shipmentStatus = 'canceled' AND EXISTS (SELECT 1 FROM e b WHERE b.orderCode = a.orderCode AND b.xd))"""
    ),
}

# ---------------------------------------------------------------- service levels


def _stops(side: str, where: str = "true") -> str:
    return f"""stops AS (SELECT * FROM e
  WHERE (shipmentStatus = 'Complete' OR {side}Status = 'Succeeded') AND {side}TimeArrived IS NOT NULL
    AND {side}WindowTo IS NOT NULL AND {where}
  QUALIFY row_number() OVER (PARTITION BY loadId, carrierName, {side}LocationName, CAST({side}_at AS DATE)
    ORDER BY {side}_at NULLS FIRST, warpId) = 1)"""


def _rates(side: str) -> str:
    total, share = {"pick": ("total_pickups", "otp_pct"), "drop": ("total_deliveries", "otd_pct")}[side]
    hits = f"count(*) FILTER ({side}_at < {side}_to)"
    return f"""count(*) AS {total}, {hits} AS on_time,
  CAST((2000 * {hits} + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS {share}"""


def _carrier_rates(side: str, where: str = "true") -> str:
    return _with(
        f"SELECT shipmentType, {_rates(side)} FROM stops GROUP BY shipmentType", _stops(side, where)
    )


def _customer_rows(side: str) -> str:
    return f"""mainShipment = 'YES' AND shipmentStatus = 'Complete' AND {side}TimeArrived IS NOT NULL
  AND {side}WindowTo IS NOT NULL"""


def _customer_rates(where: str = "true", side: str = "drop") -> str:
    return _with(
        f"""SELECT {_LANE_NAME} AS lane, startMarket, endMarket, equipment, shipmentType, {_rates(side)}
FROM e WHERE {_customer_rows(side)} AND {where} GROUP BY startMarket, endMarket, equipment, shipmentType"""
    )


def _rule(name: str, late: str, on_time: str) -> str:
    return f"count(*) FILTER ({on_time}) AS {name}_on_time, count(*) FILTER ({late}) AS {name}_late"


def _delays(side: str, code: str) -> str:
    return _with(
        f"""SELECT CASE WHEN {code} IS NULL OR {code} = '' THEN 'Carrier Failure' ELSE {code} END AS delay_code,
  count(*) AS late_legs
FROM e WHERE {side}TimeArrived IS NOT NULL AND {side}WindowTo IS NOT NULL AND xd IS DISTINCT FROM true
  AND ({side}_at < {side}_to) IS DISTINCT FROM true GROUP BY 1"""
    )


def _first(side: str) -> str:
    return f"""row_number() OVER (PARTITION BY loadId, carrierName, {side}LocationName, CAST({side}_at AS DATE)
    ORDER BY {side}_at NULLS FIRST, warpId) = 1"""


_COUNTS = """oc AS (SELECT *, count(*) OVER (PARTITION BY orderCode) AS n,
    count(*) FILTER (mainShipment = 'YES') OVER (PARTITION BY orderCode) AS n_main,
    count(*) FILTER (mainShipment = 'NO') OVER (PARTITION BY orderCode) AS n_sub,
    count(*) OVER (PARTITION BY orderCode, carrierName) AS n_carrier FROM e)"""

SERVICE = {
    "carrier_otp": _carrier_rates("pick"),
    "carrier_otp_quarter": _carrier_rates(
        "pick", "carrierName = 'Supplier#000000003' AND pick_from >= '1997-10-01' AND pick_from < '1998-01-01'"
    ),
    "carrier_otd": _carrier_rates("drop"),
    "customer_otd": _customer_rates(),
    "customer_otp": _customer_rates(side="pick"),
    "customer_otd_week": _customer_rates(_LAST_WEEK),
    "customer_otd_pivot": _with(
        f"""SELECT lane, {", ".join(
            f"avg(CASE WHEN drop_at < drop_to THEN 100.0::DOUBLE ELSE 0 END) FILTER ({c}) AS \"{q}\""
            for q, c in [*((q, f"equipment = '{q}'") for q in EQUIPMENT), ("other", f"(equipment IN ({_quoted(EQUIPMENT)})) IS NOT TRUE")])}
FROM e WHERE {_customer_rows("drop")} GROUP BY lane"""
    ),
    "site_otd": _with(
        f"""SELECT dropLocationName, shipmentType, {_rates("drop")} FROM stops GROUP BY dropLocationName, shipmentType""",
        _stops("drop", "(dropLocationName LIKE '%LOC-1%' OR dropLocationName LIKE '%Loc-1%')"),
    ),
    "pickup_dedup": _with("SELECT warpId, loadId, pickTimeArrived FROM stops", _stops("pick")),
    "keep_flags": _with(
        f"SELECT warpId, {_first('pick')} AS keep_for_pickup, {_first('drop')} AS keep_for_delivery FROM e"
    ),
    "order_row_counts": _with(
        "SELECT warpId, n AS order_rows, n_main AS order_main_rows, n_sub AS order_sub_rows FROM oc", _COUNTS
    ),
    "carrier_shipment_counts": _with(
        """SELECT carrierName, count(*) AS shipments FROM (
  SELECT *, count(*) OVER (PARTITION BY orderCode, carrierName) AS k FROM e
  WHERE shipmentType = 'Less Than Truckload')
WHERE (k > 1 AND mainShipment = 'NO') OR k = 1 GROUP BY carrierName"""
    ),
    "rows_for_customer_report": _with("SELECT warpId FROM e WHERE mainShipment = 'YES'"),
    "rows_for_carrier_report": _with(
        """SELECT warpId FROM oc WHERE CASE
  WHEN shipmentType = 'Less Than Truckload' THEN n = 1 OR mainShipment = 'NO'
  WHEN shipmentType = 'Full Truckload' AND EXISTS (SELECT 1 FROM e y WHERE y.orderCode = oc.orderCode
    AND y.mainShipment = 'YES' GROUP BY y.loadId HAVING count(*) > 1) THEN mainShipment = 'YES' ELSE true END""",
        _COUNTS,
    ),
    "bookings": _with(
        f"""SELECT carrierSaleRep, strftime(try_strptime(loadBookedTime, {_STAMP}), '%Y-%m-%d') AS booked_date,
  shipmentType, count(*) AS shipment_count FROM e WHERE loadBookedTime <> '' GROUP BY ALL"""
    ),
    "bookings_of_rep": _with(
        f"""SELECT carrierSaleRep, '1997-03-14' AS booked_date, shipmentType, count(*) AS shipment_count FROM e
WHERE carrierSaleRep = 'REP-3' AND CAST(try_strptime(loadBookedTime, {_STAMP}) AS DATE) = '1997-03-14' GROUP BY ALL"""
    ),
    "status_rules": _with(
        f"""SELECT shipmentType,
  {_rule("standard", "(pick_at < pick_to) IS DISTINCT FROM true", "pick_at < pick_to")},
  {_rule("by_nine", "pick_at > date_trunc('day', pick_from) + INTERVAL 9 HOUR",
         "pick_at <= date_trunc('day', pick_from) + INTERVAL 9 HOUR")},
  {_rule("within_two_hours", "pick_at > pick_from + INTERVAL 2 HOUR", "pick_at <= pick_from + INTERVAL 2 HOUR")},
  {_rule("half_hour_grace", "drop_at > drop_to + INTERVAL 30 MINUTE", "drop_at <= drop_to + INTERVAL 30 MINUTE")}
FROM e WHERE xd IS DISTINCT FROM true GROUP BY shipmentType"""
    ),
    "pickup_delay_reasons": _delays("pick", "pickupDelayCode"),
    "delivery_delay_reasons": _delays("drop", "deliveryDelayCode"),
    "equipment_mix": _with(
        """SELECT CASE WHEN contains(equipment, 'Reefer') THEN 'reefer' ELSE 'dry' END AS equipment_class,
  contains(equipment, '/w Lift Gate') AS has_lift_gate, contains(equipment, '/w Team') AS has_team,
  contains(equipment, '/w Pallet Jack') AS has_pallet_jack, contains(equipment, '/w Drop') AS has_drop,
  count(*) AS legs FROM e GROUP BY ALL"""
    ),
    "service_against_targets": _with(
        """SELECT kpi, CAST(target AS DOUBLE) AS target_pct, actual AS actual_pct, actual >= target AS met FROM (
  SELECT 'OTP' AS kpi, 98.5::DOUBLE AS target, count(*) FILTER (pick_at < pick_to) * 100 / count(*) AS actual FROM stops
  UNION ALL SELECT 'OTD', 99.9, count(*) FILTER (drop_at < drop_to) * 100 / count(*) FROM dstops
  UNION ALL SELECT 'OTD (some reports)', 98, count(*) FILTER (drop_at < drop_to) * 100 / count(*) FROM dstops
  UNION ALL SELECT 'Tracking', 100, count(*) FILTER (pickTimeArrived <> '' AND dropTimeArrived <> '') * 100 / count(*)
    FROM e WHERE shipmentStatus = 'Complete')""",
        _stops("pick"),
        _stops("drop").replace("stops AS", "dstops AS", 1),
    ),
}

# ---------------------------------------------------------------- companion tables


def _profit_table(source: str, keys: str, order: str, margin: bool, tail: str = "") -> str:
    share = """, CASE WHEN sum(r) <> 0
    THEN round(CAST(sum(r - c) AS DOUBLE) * 100 / CAST(sum(r) AS DOUBLE), 1) + 0.0 END AS margin_pct"""
    return f"""SELECT {keys}, count(DISTINCT {order}) AS order_count, CAST(sum(r) AS DOUBLE) AS total_revenue,
  CAST(sum(c) AS DOUBLE) AS total_cost, CAST(sum(r - c) AS DOUBLE) AS total_profit{share if margin else ""}
FROM ({source}) GROUP BY {keys} {tail}"""


_MAIN_ROWS = "SELECT *, rev AS r, cost AS c FROM e WHERE mainShipment = 'YES' AND shipmentStatus = 'Complete'"
_HEADER_ROWS = "SELECT *, hrev AS r, hcost AS c FROM oh WHERE status = 'Complete'"
_BEST = "ORDER BY sum(r - c) DESC NULLS LAST, lane, shipmentType LIMIT 20"
_LANE_TYPE = "startMarket, endMarket, lane, shipmentType"


def _from_headers(where: str = "true", once: bool = False, tail: str = "") -> str:
    distinct = "DISTINCT" if once else ""
    source = f"""SELECT {distinct} startMarket, endMarket, lane, oh.shipmentType, code, hrev AS r, hcost AS c
  FROM oh JOIN e ON code = orderCode AND mainShipment = 'YES' WHERE status = 'Complete' AND {_MARKETS} AND {where}"""
    return _with(_profit_table(source, _LANE_TYPE, "code", False, tail), _HEADERS)


def _directory(name: str, table: str, key: str) -> str:
    return _with(
        f"""SELECT CAST({key} AS VARCHAR) AS id, t.{table[0]}_name AS name, count(*) AS legs,
  CAST(sum(rev0) AS DOUBLE) AS revenue, CAST(sum(cost0) AS DOUBLE) AS cost
FROM e JOIN {table} t ON e.{name} = t.{table[0]}_name GROUP BY ALL"""
    )


COMPANIONS = {
    "customer_profit_from_headers": _with(_profit_table(_HEADER_ROWS, "shipmentType", "code", False), _HEADERS),
    "customer_profit_from_headers_month": _with(
        _profit_table(f"{_HEADER_ROWS} AND {_last_month('created')}", "shipmentType", "code", False), _HEADERS
    ),
    "customer_profit_from_legs": _with(_profit_table(_MAIN_ROWS, "shipmentType", "orderCode", True)),
    "customer_profit_from_legs_one": _with(
        _profit_table(f"{_MAIN_ROWS} AND clientName = '{CUSTOMER}'", "shipmentType", "orderCode", True)
    ),
    "lane_profit_from_headers": _from_headers(_last_month("drop_from"), tail=_BEST),
    "lane_profit_from_headers_whole": _from_headers(),
    "lane_profit_from_headers_once": _from_headers(once=True),
    "lane_profit_from_legs": _with(
        _profit_table(
            f"{_MAIN_ROWS} AND {_MARKETS} AND {_last_month('drop_from')}", _LANE_TYPE, "orderCode", True, _BEST
        )
    ),
    "lane_profit_from_legs_whole": _with(
        _profit_table(f"{_MAIN_ROWS} AND {_MARKETS}", _LANE_TYPE, "orderCode", True)
    ),
    "main_row_margins": _with(
        """SELECT warpId, CAST(rev - cost AS DOUBLE) AS profit,
  CASE WHEN rev <> 0 THEN CAST(rev - cost AS DOUBLE) / CAST(rev AS DOUBLE) END AS margin
FROM e WHERE mainShipment = 'YES'"""
    ),
    "orders_with_main_legs": _with(
        """SELECT code, customerName, status, warpId, startMarket, endMarket, loadId
FROM oh JOIN e ON code = orderCode AND mainShipment = 'YES'""",
        _HEADERS,
    ),
    "legs_with_routes": _with(
        "SELECT warpId, routes.carrierName AS route_carrier FROM e LEFT JOIN routes ON loadId = routeId", _ROUTES
    ),
    "route_agreement": _with(
        """SELECT CASE WHEN e.carrierName = routes.carrierName THEN 'same'
  WHEN e.carrierName <> routes.carrierName THEN 'different' ELSE 'unknown' END AS agreement, count(*) AS legs
FROM e LEFT JOIN routes ON loadId = routeId GROUP BY 1""",
        _ROUTES,
    ),
    "carrier_directory": _directory("carrierName", "supplier", "s_suppkey"),
    "client_directory": _directory("clientName", "customer", "c_custkey"),
    "client_quotes": _with(
        """SELECT q.customer, quotes, CAST(quoted AS DOUBLE) AS quoted, legs, CAST(revenue AS DOUBLE) AS revenue
FROM (SELECT c_name AS customer, count(*) AS quotes, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS quoted
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name) q
JOIN (SELECT clientName, count(*) AS legs, sum(rev0) AS revenue FROM e GROUP BY clientName) l
  ON q.customer = l.clientName"""
    ),
    "handling_by_site": _with(
        """SELECT dropLocationName AS crossdock, count(*) AS records, CAST(sum(rev0) AS DOUBLE) AS revenue,
  CAST(sum(cost0) AS DOUBLE) AS cost FROM e WHERE xd GROUP BY dropLocationName"""
    ),
    "legs_on_routes": _with(
        """SELECT routeId, warpId, orderCode, loadId FROM e JOIN (
  SELECT routeId, unnest(codes) AS code FROM routes) ON warpId = code""",
        _ROUTES,
    ),
    "shipment_links": _with(
        """SELECT e.shipmentWarpId, 'S-' || c.o_orderkey || '-' || strftime(c.o_orderdate, '%y%m') AS code,
  CASE WHEN p.o_orderkey IS NOT NULL
    THEN 'S-' || p.o_orderkey || '-' || strftime(p.o_orderdate, '%y%m') END AS parent_code, e.legs
FROM (SELECT shipmentWarpId, count(*) AS legs FROM e GROUP BY shipmentWarpId) e
JOIN orders c ON e.shipmentWarpId = 'S-' || c.o_orderkey
LEFT JOIN orders p ON c.o_orderkey % 5 <> 0 AND p.o_orderkey = c.o_orderkey - c.o_orderkey % 5"""
    ),
}

# ---------------------------------------------------------------- quality and statistics


def _coverage(fields: tuple[str, ...], where: str, by: str = "") -> str:
    columns = ", ".join(
        f"count(*) FILTER ({f} <> '') AS has_{f}, count(*) FILTER ({f} <> '') * 100 / count(*) AS pct_{f}" for f in fields
    )
    return _with(
        f"SELECT {by + ', ' if by else ''}count(*) AS total_rows, {columns} FROM e WHERE {where}"
        + (f" GROUP BY {by}" if by else "")
    )


_LANE_FIELDS = ("pickCity", "dropCity", "startMarket", "endMarket")


def _change(period: str, key: str = "") -> str:
    over = f"OVER ({'PARTITION BY ' + key if key else ''} ORDER BY p)"
    return _with(
        f"""SELECT {key + ", " if key else ""}strftime(p, '%Y-%m-%d') AS period, legs, CAST(amount AS DOUBLE) AS amount,
  CAST(previous AS DOUBLE) AS previous, CAST(amount - previous AS DOUBLE) AS change,
  CASE WHEN previous <> 0 THEN CAST(amount - previous AS DOUBLE) * 100 / abs(CAST(previous AS DOUBLE)) END AS change_pct
FROM (SELECT *, lag(amount) {over} AS previous FROM (
  SELECT {key + ", " if key else ""}date_trunc('{period}', delivered) AS p, count(*) AS legs,
    sum(crev - ccost) AS amount FROM e WHERE delivered IS NOT NULL GROUP BY ALL))"""
    )


_GAPS = "((month(delivered) % 4 <> 2 AND day(delivered) <= 15) OR day(delivered) = 29)"


def _every_period(unit: str, key: str, where: str = "true") -> str:
    """Sums of the legs of some weeks or months per key, with every period from the first to the last, as CTE ``f``."""
    step = "INTERVAL 7 DAYS" if unit == "week" else "INTERVAL 1 MONTH"
    return f"""s AS (SELECT {key} AS k, date_trunc('{unit}', delivered) AS p, count(*) AS legs, sum(crev - ccost) AS amount
  FROM e WHERE {_GAPS} AND {where} GROUP BY ALL),
f AS (
  SELECT k, p, coalesce(legs, 0) AS legs, coalesce(amount, 0) AS amount
  FROM (SELECT k, unnest(generate_series(CAST(min(p) AS TIMESTAMP), CAST(max(p) AS TIMESTAMP), {step})) AS p FROM s GROUP BY k) c
  LEFT JOIN (SELECT k AS sk, CAST(p AS TIMESTAMP) AS sp, legs, amount FROM s) ON p = sp AND k IS NOT DISTINCT FROM sk)"""


def _change_of_every(unit: str, key: str) -> str:
    return _with(
        f"""SELECT k AS {key}, strftime(p, '%Y-%m-%d') AS period, legs, CAST(amount AS DOUBLE) AS amount,
  CAST(previous AS DOUBLE) AS previous, CAST(amount - previous AS DOUBLE) AS change,
  CASE WHEN previous <> 0 THEN CAST(amount - previous AS DOUBLE) * 100 / abs(CAST(previous AS DOUBLE)) END AS change_pct
FROM (SELECT *, lag(amount) OVER (PARTITION BY k ORDER BY p) AS previous FROM f)""",
        _every_period(unit, key),
    )


def _statistics(source: str, pairs: dict[str, str]) -> str:
    return _with(
        "\nUNION ALL ".join(
            f"SELECT '{name}' AS statistic, round(CAST({sql} AS DOUBLE), 6) AS value FROM ({source})"
            for name, sql in pairs.items()
        )
    )


_MARGINS = "SELECT *, CAST(rev - cost AS DOUBLE) / CAST(rev AS DOUBLE) AS margin FROM e WHERE rev <> 0"

def _allocated(first: str) -> str:
    return _with(
        f"""SELECT shipmentWarpId, warpId, mainShipment, CAST(rev AS DOUBLE) AS revenueAllocationNumber,
  CAST(cost AS DOUBLE) AS costAllocationNumber, CAST(total AS DOUBLE) AS totalRevenue,
  CAST(total AS DOUBLE) AS totalCost,
  CAST(round(CAST(total AS DECIMAL(28,4)) * coalesce(CAST(rev AS DECIMAL(10,4)), 1), 2) AS DOUBLE) AS allocated_revenue,
  CAST(round(CAST(total AS DECIMAL(28,4)) * coalesce(CAST(cost AS DECIMAL(10,4)), 1), 2) AS DOUBLE) AS allocated_cost
FROM e WHERE shipmentWarpId IN (SELECT DISTINCT shipmentWarpId FROM e WHERE rev <> 1 AND rev <> 0 {first})"""
    )


QUALITY = {
    "merged_legs": _with(
        """SELECT strftime(moment, '%Y-%m-%d') AS day, count(*) AS legs, CAST(sum(crev) AS DOUBLE) AS revenue FROM (
  SELECT delivered AS moment, crev FROM e WHERE CAST(orderId AS BIGINT) % 7 <> 0 AND CAST(orderId AS BIGINT) % 11 <> 3
  UNION ALL SELECT delivered + INTERVAL 2 DAYS, crev FROM e WHERE CAST(orderId AS BIGINT) % 7 = 0
  UNION ALL SELECT delivered, crev FROM e WHERE CAST(orderId AS BIGINT) % 13 = 1
) GROUP BY 1"""
    ),
    "delivery_days": _with(
        "SELECT strftime(delivered, '%Y-%m-%d') AS day, count(*) AS legs FROM e GROUP BY 1"
    ),
    "zip_lane_labels": _with("SELECT pickZipCode || ' → ' || dropZipCode AS lane, count(*) AS legs FROM e GROUP BY 1"),
    "allocation_profile": _with(
        """SELECT mainShipment, count(*) AS total_rows, count(*) FILTER (rev IS NULL) AS rev_null,
  count(*) FILTER (rev = 0) AS rev_zero, count(*) FILTER (rev > 0) AS rev_has_value,
  count(*) FILTER (cost IS NULL) AS cost_null, count(*) FILTER (cost = 0) AS cost_zero,
  count(*) FILTER (cost > 0) AS cost_has_value FROM e GROUP BY mainShipment"""
    ),
    "multi_leg_allocations": _with(
        """SELECT shipmentWarpId, count(*) AS num_legs, CAST(sum(rev) AS DOUBLE) AS total_rev_alloc,
  CAST(sum(cost) AS DOUBLE) AS total_cost_alloc FROM e GROUP BY shipmentWarpId HAVING count(*) > 1
ORDER BY shipmentWarpId LIMIT 20"""
    ),
    "multi_leg_allocations_whole": _with(
        """SELECT shipmentWarpId, count(*) AS num_legs, CAST(sum(rev) AS DOUBLE) AS total_rev_alloc,
  CAST(sum(cost) AS DOUBLE) AS total_cost_alloc FROM e GROUP BY shipmentWarpId HAVING count(*) > 1"""
    ),
    "allocation_frequency": _with(
        """SELECT CAST(rev AS DOUBLE) AS revenueAllocationNumber, count(*) AS count FROM e WHERE rev IS NOT NULL
GROUP BY rev"""
    ),
    "allocated_amounts": _allocated(""),
    "allocated_amounts_sample": _allocated("ORDER BY shipmentWarpId LIMIT 5"),
    "allocation_stats": _with(
        """SELECT mainShipment, CAST(sum(rev) AS DOUBLE) / count(rev) AS avg_rev_alloc,
  CAST(min(rev) AS DOUBLE) AS min_rev_alloc, CAST(max(rev) AS DOUBLE) AS max_rev_alloc,
  CAST(sum(cost) AS DOUBLE) / count(cost) AS avg_cost_alloc, CAST(min(cost) AS DOUBLE) AS min_cost_alloc,
  CAST(max(cost) AS DOUBLE) AS max_cost_alloc FROM e WHERE rev IS NOT NULL GROUP BY mainShipment"""
    ),
    "lane_field_coverage": _coverage(_LANE_FIELDS, _SINCE),
    "lane_field_coverage_by_flag": _coverage(_LANE_FIELDS, _SINCE, "mainShipment"),
    "time_field_coverage": _coverage(("pickTimeArrived", "dropTimeArrived"), "true", "mainShipment"),
    "distinct_lanes": _with(
        f"""SELECT count(DISTINCT pickCity || ' -> ' || dropCity) AS city_lanes,
  count(DISTINCT startMarket || ' -> ' || endMarket) AS market_lanes FROM e WHERE {_SINCE}"""
    ),
    "top_lanes": _with(
        f"""SELECT startMarket || ' -> ' || endMarket AS lane, count(*) AS shipments, CAST(sum(rev0) AS DOUBLE) AS revenue,
  CAST(sum(cost0) AS DOUBLE) AS cost, CAST(sum(rev0) - sum(cost0) AS DOUBLE) AS profit
FROM e WHERE {_SINCE} AND {_MARKETS} GROUP BY startMarket, endMarket ORDER BY shipments DESC, lane LIMIT 15"""
    ),
    "top_lanes_whole": _with(
        f"""SELECT startMarket || ' -> ' || endMarket AS lane, count(*) AS shipments, CAST(sum(rev0) AS DOUBLE) AS revenue,
  CAST(sum(cost0) AS DOUBLE) AS cost, CAST(sum(rev0) - sum(cost0) AS DOUBLE) AS profit
FROM e WHERE {_SINCE} AND {_MARKETS} GROUP BY startMarket, endMarket"""
    ),
    "completeness": _with(
        """SELECT count(*) AS total, count(*) FILTER (pickTimeArrived IS NULL) AS missing_pick_time,
  count(*) FILTER (dropTimeArrived IS NULL) AS missing_drop_time, count(*) FILTER (rev IS NULL) AS missing_revenue
FROM e"""
    ),
    "sanity_checks": _with(
        """SELECT *, CASE WHEN timed > 0 THEN hits * 100 / timed END AS on_time_pct,
  coalesce(hits * 100 / nullif(timed, 0) < 50, false) AS on_time_implausible FROM (
  SELECT shipmentType, count(DISTINCT orderCode) AS orders, count(*) AS rows,
    count(*) FILTER (rev <> 0 AND abs(CAST(rev - cost AS DOUBLE) * 100 / CAST(rev AS DOUBLE)) > 100)
      AS margin_out_of_range,
    count(*) FILTER (rev < 50 OR rev > 10000) AS revenue_out_of_range, count(*) FILTER (cost0 = 0) AS without_cost,
    count(drop_at) AS timed, count(*) FILTER (drop_at < drop_to) AS hits FROM e GROUP BY shipmentType)
  JOIN (SELECT shipmentType, count(*) FILTER (k > CASE shipmentType WHEN 'Less Than Truckload' THEN 20
      WHEN 'Full Truckload' THEN 10 END) AS orders_with_many_rows
    FROM (SELECT shipmentType, orderCode, count(*) AS k FROM e GROUP BY ALL) GROUP BY shipmentType)
  USING (shipmentType)"""
    ).replace("SELECT *, CASE WHEN timed", "SELECT * EXCLUDE (timed, hits), CASE WHEN timed"),
    "margin_summary": _statistics(
        f"{_MARGINS} AND mainShipment = 'YES'",
        {
            "mean": "avg(margin)",
            "std": "stddev_samp(margin)",
            "median": "quantile_cont(margin, 0.5)",
            "p90": "quantile_cont(margin, 0.9)",
        },
    ),
    "margin_distribution": _statistics(
        f"{_MARGINS} AND cost IS NOT NULL",
        {
            "weighted_mean": "CAST(sum(rev - cost) AS DOUBLE) / CAST(sum(rev) AS DOUBLE)",
            "variance": "var_samp(margin)",
            "revenue_cost_correlation": "corr(CAST(rev AS DOUBLE), CAST(cost AS DOUBLE))",
            "p10": "quantile_cont(margin, 0.1)",
            "p50": "quantile_cont(margin, 0.5)",
            "p90": "quantile_cont(margin, 0.9)",
        },
    ),
    "weekly_change": _change("week"),
    "weekly_change_by_type": _change("week", "shipmentType"),
    "monthly_change": _change("month"),
    "weekly_change_of_every_week": _change_of_every("week", "shipmentType"),
    "monthly_change_of_every_month": _change_of_every("month", "carrierSaleRep"),
    "rolling_profit_of_every_month": _with(
        """SELECT k AS lane, strftime(p, '%Y-%m-%d') AS period, legs, CAST(amount AS DOUBLE) AS amount,
  CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w AS rolling_avg
FROM f WINDOW w AS (PARTITION BY k ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
        _every_period("month", "lane"),
    ),
    "distinct_lanes_estimated": _with(
        """SELECT year(delivered) AS year, count(DISTINCT pickCity || dropCity) AS city_lanes,
  count(DISTINCT startMarket || '>' || endMarket) AS market_lanes, count(DISTINCT warpId) AS legs,
  TRUE AS city_lanes_within_bound, TRUE AS market_lanes_within_bound, TRUE AS legs_within_bound
FROM e WHERE delivered IS NOT NULL GROUP BY 1"""
    ),
    "rolling_profit": _with(
        """SELECT lane, strftime(p, '%Y-%m-%d') AS period, legs, CAST(amount AS DOUBLE) AS amount,
  CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w AS rolling_avg
FROM (SELECT lane, date_trunc('month', delivered) AS p, count(*) AS legs, sum(crev - ccost) AS amount
  FROM e WHERE lane IS NOT NULL AND delivered IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY lane ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""
    ),
}

ORACLE = {**LANES, **STRATEGIES, **SERVICE, **COMPANIONS, **QUALITY}
