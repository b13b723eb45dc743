"""Labels and classes derived from a leg's own columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ARROW = " → "
CITY_ARROW = " -> "


def lane_label(origin: str, destination: str, arrow: str = ARROW) -> Column:
    """``origin → destination``; NULL if either end is."""
    return F.concat(F.col(origin), F.lit(arrow), F.col(destination))


def zip_lane_display() -> Column:
    """A zip lane with its representative cities."""
    return F.concat(
        F.col("lane"), F.lit(" ("), F.col("pickCity"), F.lit(ARROW), F.col("dropCity"), F.lit(")")
    )


def split_lane(lane: str | None) -> tuple[str, str] | None:
    """Lane text as a market pair, or None if it is not exactly two parts."""
    ends = (lane or "").split(ARROW)
    return (ends[0], ends[1]) if len(ends) == 2 else None


def yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("Yes")).otherwise(F.lit("No"))


def comparison_tag(lane: Column, selected: str | Column) -> Column:
    return F.when(lane == selected, F.lit("Selected")).otherwise(F.lit("Similar Mileage"))


# The add-on marks within equipment names.
EQUIPMENT_ADD_ONS = {
    "has_lift_gate": "/w Lift Gate",
    "has_team": "/w Team",
    "has_pallet_jack": "/w Pallet Jack",
    "has_drop": "/w Drop",
}


def equipment_class(equipment: Column) -> Column:
    """``reefer`` for refrigerated equipment, ``dry`` for any other, NULL if unknown."""
    return F.when(equipment.contains("Reefer"), F.lit("reefer")).when(equipment != "", F.lit("dry"))


def equipment_add_ons(equipment: Column) -> dict[str, Column]:
    return {name: F.coalesce(equipment.contains(mark), F.lit(False)) for name, mark in EQUIPMENT_ADD_ONS.items()}


def shipment_number(code: Column) -> Column:
    """The number in ``S-123``; plain digits stay as they are, other text is NULL."""
    digits = F.regexp_extract(code, r"^(?:S-)?(\d+)$", 1)
    return F.when(digits != "", digits)


def shipment_code(number: Column) -> Column:
    """``S-123`` for ``123``."""
    return F.concat(F.lit("S-"), shipment_number(number))
