"""Rows next to facts about their group.

Groups are summed before they are shuffled, so one that holds a large part of
all rows shrinks to a row per task.  Keys are matched null-safely: NULL is a
group like any other, and since the join is then on other expressions than the
aggregation, both of its sides come straight from a shuffle of their own, which
lets adaptive execution split the rows of a large group over several tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _renamed(facts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The facts with keys of other names, and the condition that matches them."""
    other = facts.withColumnsRenamed({key: f"_group_{key}" for key in keys})
    matches = [F.col(key).eqNullSafe(F.col(f"_group_{key}")) for key in keys]
    return other, reduce(Column.__and__, matches)


def semi_join(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ``wanted`` keys; NULL matches NULL."""
    other, condition = _renamed(wanted.select(key), [key])
    return rows.join(other, condition, "left_semi")


def lookup_join(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """Rows with the facts of their keys, where ``facts`` has one row per group."""
    other, condition = _renamed(facts, keys)
    return rows.join(other, condition).drop(*[f"_group_{key}" for key in keys])


def with_group_sums(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Rows with sums over their group, as a window over the whole group would give."""
    totals = rows.groupBy(*keys).agg(*[F.sum(column).alias(name) for name, column in sums.items()])
    return lookup_join(rows, totals, *keys)
