"""Joins of persons, households and dwellings, and their checks.

Hot keys are left to adaptive execution: every shuffle join here reads both sides
straight from a shuffle, so a skewed partition is split at run time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import quoted


def join_keeping(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    left_items: Iterable[str],
    right_items: Iterable[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join on ``left column -> right column``; each side gives its own select items.

    Items are ``selectExpr`` texts over the side they come from, so equal column names on
    the two sides do not clash.
    """
    keys = list(on.items())
    lhs = left.selectExpr(*[f"{quoted(a)} AS __l{i}" for i, (a, _) in enumerate(keys)], *left_items)
    rhs = right.selectExpr(*[f"{quoted(b)} AS __r{i}" for i, (_, b) in enumerate(keys)], *right_items)
    cond = reduce(and_, [F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(keys))])
    helpers = [f"__{s}{i}" for s in "lr" for i in range(len(keys))]
    return lhs.join(rhs, cond, how).drop(*helpers)


def null_safe(left: DataFrame, right: DataFrame, keys: Mapping[str, str]) -> Column:
    """Condition that also matches null with null."""
    return reduce(and_, [left[quoted(a)].eqNullSafe(right[quoted(b)]) for a, b in keys.items()])


def fan_out(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after a join and whether they differ."""
    sides = before.agg(F.count("*").alias("b"), F.lit(None).cast("long").alias("a")).unionByName(
        after.agg(F.lit(None).cast("long").alias("b"), F.count("*").alias("a"))
    )
    return sides.agg(
        F.max("b").alias("rows_before"),
        F.max("a").alias("rows_after"),
        (F.max("a") != F.max("b")).alias("changed"),
    )


def key_audit(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """One row for a side of a join: rows, distinct keys, rows with a null in the key."""
    null_key = reduce(or_, [F.col(quoted(k)).isNull() for k in keys])
    return df.agg(
        F.lit(side).alias("side"),
        F.count("*").alias("rows"),
        F.count_distinct(F.struct(*[quoted(k) for k in keys])).alias("distinct_keys"),
        F.count_if(null_key).alias("null_keys"),
    )


def join_key_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return key_audit(left, keys, "left").unionByName(key_audit(right, keys, "right"))
