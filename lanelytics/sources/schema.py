"""Schemas of the tables the operators accept."""

from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F, types as T

MONEY = T.DecimalType(18, 4)

_LEG_TEXT = """
orderCode warpId loadId orderId shipmentWarpId
clientName carrierName carrierSaleRep
mainShipment shipmentType shipmentStatus accessorialType equipment
startMarket endMarket pickLocationName dropLocationName
pickCity dropCity pickState dropState pickZipCode dropZipCode
pickWindowFrom pickWindowTo pickTimeArrived dropWindowFrom dropWindowTo
dropTimeArrived dropDateArrived loadBookedTime
pickStatus dropStatus pickupDelayCode deliveryDelayCode
""".split()
_LEG_MONEY = "revenueAllocationNumber costAllocationNumber totalRevenue totalCost".split()

LEGS = T.StructType(
    [T.StructField(name, T.StringType()) for name in _LEG_TEXT]
    + [T.StructField(name, MONEY) for name in _LEG_MONEY]
    + [T.StructField("shipmentMiles", T.DoubleType())]
)


def _text(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


ORDER_HEADERS = _text("code customerName status shipmentType revenueAllocation costAllocation createdAt")
ROUTES = _text("routeId carrierName shipmentCodes shipmentWarpIds")
CARRIERS = _text("id name")
CLIENTS = _text("id name")
SHIPMENTS = _text("warpId parent code")

# The spellings every status comparison expects.
STATUS_SPELLINGS = {
    "complete": "Complete",
    "canceled": "canceled",
    "removed": "removed",
    "pending": "Pending",
}


def normalize_status(df: DataFrame, column: str = "shipmentStatus") -> DataFrame:
    """Bring known statuses to one spelling; comparisons elsewhere are case sensitive."""
    status = F.col(column)
    normalized = status
    for lowered, spelling in STATUS_SPELLINGS.items():
        normalized = F.when(F.lower(status) == lowered, F.lit(spelling)).otherwise(normalized)
    return df.withColumn(column, normalized)


def conform_legs(df: DataFrame, allow_missing: Collection[str] = ()) -> DataFrame:
    """Project a landed leg table to the declared columns and types.

    Columns named in ``allow_missing`` become NULL where they are absent, so a
    partial extract can still be queried; any other absence is an error.
    Columns that are not part of the schema are dropped.
    """
    present = {name.lower(): name for name in df.columns}
    missing = {f.name for f in LEGS.fields if f.name.lower() not in present} - set(allow_missing)
    if missing:
        raise ValueError(f"leg columns are missing: {', '.join(sorted(missing))}")
    return normalize_status(
        df.select(
            *[
                (F.col(present[f.name.lower()]) if f.name.lower() in present else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in LEGS.fields
            ]
        )
    )
