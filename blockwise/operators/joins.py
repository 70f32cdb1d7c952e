"""Join helpers: natural joins, NULL-matching joins, filtering joins, unions.

No helper forces a broadcast of a data-derived side. Small literal lookups
(tens of rows, size known) are hinted; every other join is left to AQE, which
turns it into a broadcast only when the measured side is under
``spark.sql.autoBroadcastJoinThreshold`` and keeps the sort-merge plan (with
skew splitting) beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """dplyr join without ``by``: keys are the shared column names."""
    return join_on(a, b, shared_columns(a, b), how=how, null_safe=null_safe)


def join_on(
    a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Equi join on same-named keys; ``null_safe`` matches NULL with NULL (T1, dplyr's default).

    Output has one copy of each key column, like dplyr.
    """
    keys = list(keys)
    if not null_safe:
        return a.join(b, on=keys, how=how)
    rb = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = a.join(rb, on=cond, how=how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def join_chain(frames: Sequence[DataFrame], keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """``reduce(list, left_join, by = keys)``."""
    return reduce(lambda x, y: join_on(x, y, keys, how="left", null_safe=null_safe), frames)


def combine_by_key(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Merge frames that each hold at most one row per key into one wide row per key.

    Same rows as a NULL-matching full outer join chain, but one shuffle: the
    frames are stacked by name and grouped once. NULL keys form one group,
    as dplyr's joins match NULL with NULL. Columns must be unique across frames.
    """
    keys = list(keys)
    stacked = union_rows(*frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def semi_join(a: DataFrame, b: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None) -> DataFrame:
    """``semi_join`` (also with differently named keys); never ``isin`` of a collected list."""
    return _filtering(a, b, left_on, right_on, "left_semi")


def anti_join(a: DataFrame, b: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None) -> DataFrame:
    """``anti_join``: ``NOT EXISTS`` semantics (a NULL key on the left is kept)."""
    return _filtering(a, b, left_on, right_on, "left_anti")


def _filtering(a, b, left_on, right_on, how):
    left_on = list(left_on)
    right_on = list(right_on or left_on)
    rb = b.select(*[F.col(r).alias(f"__r{i}") for i, r in enumerate(right_on)])
    cond = reduce(lambda x, y: x & y, [F.col(l) == F.col(f"__r{i}") for i, l in enumerate(left_on)])
    return a.join(rb, on=cond, how=how)


def lookup(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a literal lookup table of known, fixed size (broadcast hint is safe)."""
    return df.join(F.broadcast(small), on=list(keys), how=how)


def union_rows(*frames: DataFrame) -> DataFrame:
    """``bind_rows``: by name, missing columns NULL."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """``bind_rows(...) |> distinct()``."""
    return union_rows(*frames).distinct()


def full_outer_on_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side with the rows of both (the reference's union of keys and two left joins, T17).

    A NULL-matching full outer join gives the same rows, the fan-out of
    non-unique keys included, with one exchange of each side.
    """
    return join_on(a, b, keys, "full_outer", null_safe=True)
