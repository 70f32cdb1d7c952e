"""Observation clean-up (C1), shared-checklist collapse (C2), start-time repair (C7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import build_local_datetime, month_label, parse_number, squish
from blockwise.operators.aggregate import multi_valued_keys
from blockwise.operators.joins import lookup
from blockwise.plans.lookups import breeding_lookup
from blockwise.session import LOCAL_TZ


def clean_observations(raw: DataFrame, tz: str = LOCAL_TZ, default_category: str = "C1") -> DataFrame:
    """Squish codes, missing category -> ``default_category``, month label, local datetime, block rename."""
    out = raw.withColumns(
        {
            "breeding_code": squish("breeding_code"),
            "breeding_category": F.coalesce(squish("breeding_category"), F.lit(default_category)),
            "observation_month": month_label("observation_date"),
            "observation_month_num": F.month("observation_date"),
            "observation_datetime": build_local_datetime("observation_date", "time_observations_started", tz),
        }
    )
    if "atlas_block" in out.columns:
        out = out.withColumnRenamed("atlas_block", "pba3_block")
    return out


def with_breeding_rank(obs: DataFrame) -> DataFrame:
    """Attach description and rank 0-4 (broadcast join to the 5-row lookup)."""
    return lookup(obs, breeding_lookup(obs.sparkSession), ["breeding_category"])


def with_count(obs: DataFrame, column: str = "observation_count") -> DataFrame:
    """Count text -> number (``"X"`` -> 1)."""
    return obs.withColumn(column, parse_number(column))


def collapse_shared(
    rows: DataFrame,
    group_col: str = "group_identifier",
    event_col: str = "sampling_event_identifier",
    species_col: str = "common_name",
    observer_col: str = "observer_id",
    category_col: str = "breeding_category",
) -> DataFrame:
    """One checklist id per shared group and one row per species.

    ``checklist_id`` = group id, or the event id when not shared; observers of
    the species' rows comma-joined in sorted order; the highest category is
    kept; the remaining columns come from the member with the smallest event id
    (ties: smallest value).
    """
    cid = F.coalesce(F.col(group_col), F.col(event_col))
    keyed = rows.withColumn("checklist_id", cid)
    rest = [c for c in rows.columns if c not in (group_col, event_col, species_col, observer_col, category_col)]
    aggs = [
        F.array_join(F.sort_array(F.collect_set(observer_col)), ",").alias(observer_col),
        F.max(squish(category_col)).alias(category_col),
        F.min(event_col).alias("first_event_id"),
    ] + [F.min_by(F.col(c), F.struct(F.col(event_col), F.col(c))).alias(c) for c in rest]
    return keyed.groupBy("checklist_id", species_col).agg(*aggs)


def dupe_start_checklists(obs: DataFrame, checklist: str = "checklist_id", dt: str = "observation_datetime") -> DataFrame:
    """Checklists with more than one distinct start (NULL counts as one), with ``n``."""
    return multi_valued_keys(obs, checklist, dt, min_values=2)


def modal_start_times(
    obs: DataFrame,
    checklist: str = "checklist_id",
    dt: str = "observation_datetime",
    observer: str = "observer_id",
    block: str = "pba3_block",
) -> DataFrame:
    """(checklist_id, observation_datetime_fixed): modal start per multi-start checklist.

    The mode is taken after splitting the observer list, so a time reported by
    k observers weighs k (T12); ties go to the earliest time (T11). A chain of
    aggregates by growing keys and no join: on rows that are already
    partitioned by ``checklist`` it adds no exchange.
    """
    rows = obs.where(F.col(checklist).isNotNull()).select(block, checklist, observer, dt).distinct()
    weight = F.coalesce(F.size(F.split(F.col(observer), ",")), F.lit(1))  # a missing list is one observer
    per_start = rows.groupBy(checklist, dt).agg(F.sum(weight).alias("__n"))
    rank = F.when(F.col(dt).isNotNull(), F.struct((-F.col("__n")).alias("k1"), F.col(dt).alias("k2")))
    modes = per_start.groupBy(checklist).agg(F.count(F.lit(1)).alias("__starts"), F.min_by(F.col(dt), rank).alias(f"{dt}_fixed"))
    return modes.where((F.col("__starts") > 1) & F.col(f"{dt}_fixed").isNotNull()).drop("__starts")


def apply_start_fix(df: DataFrame, fixed: DataFrame, checklist: str = "checklist_id", dt: str = "observation_datetime") -> DataFrame:
    """Replace start times of repaired checklists by their modal time."""
    return (
        df.join(fixed, on=checklist, how="left")
        .withColumn(dt, F.coalesce(F.col(f"{dt}_fixed"), F.col(dt)))
        .drop(f"{dt}_fixed")
    )
