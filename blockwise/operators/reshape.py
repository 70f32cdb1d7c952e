"""Projection, renaming, pivots, list columns and ``complete``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.operators.joins import join_on


def select_matching(
    df: DataFrame,
    first: Sequence[str] = (),
    starts_with: str | None = None,
    contains: str | None = None,
    any_of: Sequence[str] = (),
    everything: bool = False,
    drop: Sequence[str] = (),
) -> DataFrame:
    """``select(first..., starts_with(), contains(), any_of(), everything())`` minus ``drop``."""
    out: list[str] = []

    def add(c: str) -> None:
        if c not in out and c not in drop:
            out.append(c)

    for c in first:
        add(c)
    for c in df.columns:
        if starts_with is not None and c.startswith(starts_with):
            add(c)
        if contains is not None and contains in c:
            add(c)
        if c in any_of:
            add(c)
    if everything:
        for c in df.columns:
            add(c)
    return df.select(*out)


def rename_with(df: DataFrame, fn: Callable[[str], str], where: Callable[[str], bool] = lambda c: True) -> DataFrame:
    """``rename_with(.fn, .cols)``: rename the matching columns by a function."""
    mapping = {c: fn(c) for c in df.columns if where(c) and fn(c) != c}
    return df.withColumnsRenamed(mapping) if mapping else df


def rename_positional(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """``rename(new = 1, ...)``: rename by 1-based position."""
    return df.withColumnsRenamed({df.columns[i - 1]: n for i, n in names.items()})


def str_remove_fn(pattern: str) -> Callable[[str], str]:
    """Name function that drops the first match of ``pattern`` (for ``rename_with``)."""
    rx = re.compile(pattern)
    return lambda name: rx.sub("", name, count=1)


def across(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """``mutate(across(cols, fn))``: one ``withColumns`` projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def pivot_longer(
    df: DataFrame, id_cols: Sequence[str], names_to: str, values_to: str, value_cols: Sequence[str] | None = None
) -> DataFrame:
    """``pivot_longer(-id_cols)``: wide -> long in column order (keeps NULL values)."""
    value_cols = [c for c in (value_cols or df.columns) if c not in id_cols]
    return df.unpivot(list(id_cols), value_cols, names_to, values_to)


def pivot_wider(
    df: DataFrame,
    id_cols: Sequence[str],
    names_from: str,
    values_from: str,
    values: Sequence[str],
    names_prefix: str = "",
) -> DataFrame:
    """``pivot_wider`` with a fixed value list (T22): every listed column exists; absent cells NULL.

    Expects one row per (id_cols, names_from); ``first`` keeps the value.
    """
    out = df.groupBy(*id_cols).pivot(names_from, list(values)).agg(F.first(values_from))
    if names_prefix:
        out = out.withColumnsRenamed({v: f"{names_prefix}{v}" for v in values})
    return out


def explode_delimited(df: DataFrame, column: str, delim: str = ",") -> DataFrame:
    """``separate_longer_delim``: one row per piece, no trimming; NULL stays one NULL row."""
    return df.withColumn(column, F.explode_outer(F.split(F.col(column), re.escape(delim))))


def nest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str, order_by: Sequence[str] = ()) -> DataFrame:
    """``group_nest(keys, .key=name)``: ``ARRAY<STRUCT>`` per key, sorted for determinism."""
    sort_fields = list(order_by) + [f for f in fields if f not in order_by]
    s = F.struct(*[F.col(f) for f in sort_fields])
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(s)).alias(name))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """``unnest(list_col)``: rows per element; empty / NULL lists drop (T22)."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(F.col(column)))


def complete_keys(df: DataFrame, key: str, others: Sequence[str], fill: dict[str, object], most: int = 10_000) -> DataFrame:
    """``complete(key, others...)`` + fill: every distinct ``key`` with every combination of the ``others``' values.

    The values of the others are small domains (months, categories): they come
    to the driver, at most ``most`` each, else this raises. The distinct keys
    are exploded by their combinations and meet the rows in one join, so
    nothing is joined without a key. NULL is a value like others.
    """
    domains = {}
    for c in others:
        domains[c] = df.select(c).distinct().limit(most + 1).collect()
        if len(domains[c]) > most:
            raise ValueError(f"{c} has more than {most} values; complete it as the key")
    grid = df.select(key).distinct()
    for c, rows in domains.items():
        kind = df.schema[c].dataType
        grid = grid.withColumn(c, F.explode(F.array(*[F.lit(r[0]).cast(kind) for r in rows])))
    return join_on(grid, df, [key, *others], "left", null_safe=True).na.fill(fill)


def complete_values(df: DataFrame, key: str, all_keys: DataFrame, fill: dict[str, object]) -> DataFrame:
    """``complete(key = values)`` + fill: left join the key universe, fill the gaps."""
    return all_keys.select(key).distinct().join(df, on=key, how="left").na.fill(fill)
