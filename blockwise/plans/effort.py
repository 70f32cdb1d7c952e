"""Sun times (C5), day / night / unknown effort (C8), effort over time (C18), effort audit (C20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import MONTH_ABB, from_utc, month_label, row_sum, strict_sum, sum0, utc_clock
from blockwise.functions.sun import with_sun_events_utc
from blockwise.operators.joins import join_on
from blockwise.operators.reshape import nest, unnest
from blockwise.plans.clean import apply_start_fix
from blockwise.session import LOCAL_TZ

CLASSES = ["diurnal", "nocturnal", "unknown"]
# A start counts as daytime from 40 minutes before sunrise to
# 20 minutes after sunset (both ends included).
MINUTES_BEFORE_SUNRISE = 40
MINUTES_AFTER_SUNSET = 20
DURATION_COLS = [f"duration_hours_{c}" for c in CLASSES]


def sun_times(obs: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Sunrise and sunset (local) for each distinct (longitude, latitude, observation_datetime).

    The reference runs an external solver per row in worker processes; here
    it is column maths on the distinct table, one narrow stage after the
    distinct's shuffle.
    """
    keys = obs.select("longitude", "latitude", "observation_datetime").distinct()
    utc = with_sun_events_utc(keys, "longitude", "latitude", F.to_date("observation_datetime"), "__r", "__s")
    return utc.select(
        "longitude", "latitude", "observation_datetime",
        from_utc("__r", tz).alias("sunrise"), from_utc("__s", tz).alias("sunset"),
    )


def classify_checklists(
    obs: DataFrame,
    fixed: DataFrame | None = None,
    group: Sequence[str] = (),
    tz: str = LOCAL_TZ,
    before_min: int = MINUTES_BEFORE_SUNRISE,
    after_min: int = MINUTES_AFTER_SUNSET,
) -> DataFrame:
    """One row per (group..., pba3_block, checklist_id, longitude, latitude) with its class.

    Start = earliest (repaired) start, duration = longest (0 if none, T3);
    diurnal when start is within [sunrise - before, sunset + after] inclusive,
    nocturnal when outside, unknown when start or sun time is missing. Groups
    by location too, as the reference does (T20). Sun times are computed in
    place rather than joined from a memo table: the solver is pure column
    maths, so no shuffle is needed for it.
    """
    keys = [*group, "pba3_block", "checklist_id", "longitude", "latitude"]
    per = obs.groupBy(*keys).agg(
        F.min("observation_datetime").alias("observation_datetime"),
        F.coalesce(F.max("duration_minutes"), F.lit(0.0)).cast("double").alias("duration_minutes"),
    )
    if fixed is not None:
        per = apply_start_fix(per, fixed)
    return add_day_night_class(per, tz, before_min, after_min)


def add_day_night_class(
    per: DataFrame, tz: str = LOCAL_TZ, before_min: int = MINUTES_BEFORE_SUNRISE, after_min: int = MINUTES_AFTER_SUNSET
) -> DataFrame:
    """Add ``checklist_type`` from ``observation_datetime``, ``longitude``, ``latitude``."""
    per = with_sun_events_utc(per, "longitude", "latitude", F.to_date("observation_datetime"), "__rise", "__set", seconds=True)
    start = F.unix_micros(F.to_utc_timestamp(utc_clock("observation_datetime"), tz))
    day = start.between((F.col("__rise") - before_min * 60) * 1000000, (F.col("__set") + after_min * 60) * 1000000)
    per = per.withColumn("__day", day)
    kind = F.when(F.col("__day"), "diurnal").when(~F.col("__day"), "nocturnal").otherwise("unknown")
    return per.withColumn("checklist_type", kind).drop("__rise", "__set", "__day")


def day_night_hours(classified: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Hours per class, wide, missing classes 0: (group..., pba3_block, duration_hours_*)."""
    hours = [
        (sum0(F.when(F.col("checklist_type") == c, F.col("duration_minutes"))) / 60).alias(f"duration_hours_{c}")
        for c in CLASSES
    ]
    return classified.groupBy(*group, "pba3_block").agg(*hours)


def effort_by_date(classified: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Hours per (block, local date, class), wide; absent classes stay NULL."""
    dated = classified.withColumn("observation_date", F.to_date("observation_datetime"))
    is_c = {c: F.col("checklist_type") == c for c in CLASSES}
    hours = [
        F.when(F.count_if(is_c[c]) > 0, sum0(F.when(is_c[c], F.col("duration_minutes"))) / 60).alias(f"duration_hours_{c}")
        for c in CLASSES
    ]
    return dated.groupBy(*group, "pba3_block", "observation_date").agg(*hours)


def nest_effort(by_date: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``group_nest`` of the dated hours into ``effort_breakdown`` (one row per block)."""
    return nest(
        by_date, [*group, "pba3_block"], ["observation_date", *DURATION_COLS], "effort_breakdown", ["observation_date"]
    )


def day_night_effort(
    obs: DataFrame, fixed: DataFrame | None = None, group: Sequence[str] = (), tz: str = LOCAL_TZ, nested: bool = True
) -> DataFrame:
    """Per block: diurnal / nocturnal / unknown hours and, if ``nested``, the dated breakdown."""
    classified = classify_checklists(obs, fixed, group, tz)
    hours = day_night_hours(classified, group)
    if not nested:
        return hours
    return join_on(hours, nest_effort(effort_by_date(classified, group), group), [*group, "pba3_block"], "left", True)


def effort_over_time(breakdown: DataFrame, strict: bool = True) -> DataFrame:
    """Unnested breakdown -> total hours per (year, month), month as label plus number.

    As R's ``sum`` without ``na.rm``, a month with a day that lacks a class has no
    total of that class (T5), while the daily totals ignore missing classes;
    ``strict=False`` sums the days that have it.
    """
    flat = unnest(breakdown, "effort_breakdown") if "effort_breakdown" in breakdown.columns else breakdown
    flat = flat.withColumns(
        {
            "obs_year": F.year("observation_date"),
            "obs_month_num": F.month("observation_date"),
            "obs_month": month_label("observation_date"),
            "duration_hours_total": row_sum(*DURATION_COLS),
        }
    )
    total = strict_sum if strict else F.sum
    return flat.groupBy("obs_year", "obs_month_num", "obs_month").agg(
        *[total(c).alias(c) for c in ["duration_hours_total", *DURATION_COLS]]
    )


def effort_audit(obs: DataFrame) -> DataFrame:
    """Naive vs per-checklist-max effort per block, and their differences.

    Naive sums every distinct (checklist, duration, distance) row; adjusted
    takes the max per checklist first.
    """
    base = obs.select("pba3_block", "checklist_id", "duration_minutes", "effort_distance_km")
    naive = (
        base.distinct()
        .groupBy("pba3_block")
        .agg(
            (sum0("duration_minutes") / 60).alias("duration_hours_total_naive"),
            sum0("effort_distance_km").alias("effort_distance_km_naive"),
        )
    )
    adj = (
        base.groupBy("pba3_block", "checklist_id")
        .agg(F.max("duration_minutes").alias("d"), F.max("effort_distance_km").alias("k"))
        .groupBy("pba3_block")
        .agg((sum0("d") / 60).alias("duration_hours_total_adj"), sum0("k").alias("effort_distance_km_adj"))
    )
    out = join_on(naive, adj, ["pba3_block"], "left", null_safe=True)
    return out.withColumns(
        {
            "duration_hours_diff": F.col("duration_hours_total_adj") - F.col("duration_hours_total_naive"),
            "effort_distance_diff": F.col("effort_distance_km_adj") - F.col("effort_distance_km_naive"),
        }
    )


def effort_audit_means(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.avg("duration_hours_diff").alias("mean_duration_hours_diff"),
        F.avg("effort_distance_diff").alias("mean_effort_distance_diff"),
    )


def effort_audit_changed(audit: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Blocks whose hours or distance change; differences up to ``tolerance`` are rounding of the two sums."""
    return audit.where((F.abs("duration_hours_diff") > tolerance) | (F.abs("effort_distance_diff") > tolerance))


__all__ = [
    "MONTH_ABB",
    "sun_times",
    "classify_checklists",
    "day_night_hours",
    "effort_by_date",
    "nest_effort",
    "day_night_effort",
    "effort_over_time",
    "effort_audit",
    "effort_audit_means",
    "effort_audit_changed",
]
