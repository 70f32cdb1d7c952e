"""Grouped aggregates: counts, mode, rows at the group maximum, add_count.

All are hash aggregates with a map-side partial step; none gathers a group's
rows into one task, so a key holding a third of the data stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import strict_max
from blockwise.operators.joins import join_on


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n", sort: bool = False) -> DataFrame:
    """``count(keys, name=, sort=)``; NULL keys form their own group."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.col(name).desc(), *keys) if sort else out


def count_of_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """``count(keys) |> count(n)``: how many keys have each row count."""
    per_key = count_by(df, keys, "n")
    return per_key.groupBy("n").agg(F.count(F.lit(1)).alias(name if name != "n" else "nn"))


def modal_value(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Statistical mode of ``value`` per group (T11): most frequent non-NULL value, ties -> smallest.

    Two partial-aggregating steps (count per value, then ``min_by``), so no group
    is ever materialised in one task. Groups with only NULL values are absent.
    """
    out = out or f"{value}_mode"
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    order = F.struct((-F.col("__n")).alias("k1"), F.col(value).alias("k2"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(value), order).alias(out))


def rows_at_group_max(df: DataFrame, keys: Sequence[str], value: str, strict: bool = False) -> DataFrame:
    """``group_by(keys) |> filter(value == max(value))``; ties all kept.

    ``strict=True`` copies R's ``max`` without ``na.rm`` (T4): a NULL in the
    group removes the whole group. Aggregate + join (AQE splits a skewed key),
    not a window over the raw group.
    """
    m = strict_max(value) if strict else F.max(value)
    maxes = df.groupBy(*keys).agg(m.alias("__max"))
    return (
        join_on(df, maxes, keys, how="inner", null_safe=True)
        .where(F.col(value) == F.col("__max"))
        .drop("__max")
    )


def add_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """``add_count(keys)``: per-row group size (aggregate + NULL-safe join, skew-splittable)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return join_on(df, counts, keys, how="left", null_safe=True)


def multi_valued_keys(df: DataFrame, key: str, value: str, min_values: int = 2) -> DataFrame:
    """Keys with at least ``min_values`` distinct values (NULL counts as a value), with ``n``."""
    return (
        df.select(key, value)
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_values)
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur on more than one row (uniqueness check; empty = pass)."""
    return count_by(df, keys).where(F.col("n") > 1)
