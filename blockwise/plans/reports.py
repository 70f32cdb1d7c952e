"""Dashboard data jobs: completion flags (C13), progress (C14), block report (C16),
checklist density (C17), region hierarchy (C19), focal match (C21), map values (C22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import r_div
from blockwise.operators.joins import anti_join, union_rows
from blockwise.operators.reshape import pivot_longer
from blockwise.plans.lookups import ALL_SEASONS
from blockwise.plans.season import season_fanout

# Completion criteria thresholds.
MIN_CODED_SPECIES = 70
MIN_CONFIRMED_SHARE = 0.25
MAX_POSSIBLE_SHARE = 0.25
MIN_CODED_VS_OLD_ATLAS = 0.8
MIN_EFFORT_HOURS = 20
MIN_BREEDING_MONTHS = 3
MIN_NOCTURNAL_SPECIES = 2
MIN_NOCTURNAL_HOURS = 2

FLAGS = [
    "flag_coded_species",
    "flag_confirmed_pct",
    "flag_possible_pct",
    "flag_coded_atlas_comparison",
    "flag_20_effort_hours",
    "flag_breeeding_season_coverage",
    "flag_nocturnal_coverage",
]


#: Hours and kilometres of the dashboard are rounded to 2 places before anything is derived from them.
ROUNDED = ["duration_hours_total", "duration_hours_diurnal", "duration_hours_nocturnal", "duration_hours_unknown", "effort_distance_km"]


def dashboard_summary(summary: DataFrame) -> DataFrame:
    """The block summary as every dashboard table reads it: hours and km half-to-even at 2 places."""
    return summary.withColumns({c: F.bround(c, 2) for c in ROUNDED if c in summary.columns})


def completion_flags(summary: DataFrame, season: str = ALL_SEASONS) -> DataFrame:
    """Seven completion criteria and their three-valued AND (R's ``&``, Kleene).

    Shares use R's division (T6): no coded species gives NULL shares, so the
    share flags are NULL; a block with no old-atlas coded species has an
    infinite ratio and passes the 80 % rule.
    """
    s = dashboard_summary(summary).where((F.col("season") == season) & F.col("pba3_block").isNotNull()).na.fill(
        {"Observed": 0, "Possible": 0, "Probable": 0, "Confirmed": 0}
    )
    s = s.withColumn("species_coded", F.col("Possible") + F.col("Probable") + F.col("Confirmed"))
    s = s.withColumns(
        {
            "possible_pct": r_div("Possible", "species_coded"),
            "probable_pct": r_div("Probable", "species_coded"),
            "confirmed_pct": r_div("Confirmed", "species_coded"),
        }
    )
    s = s.withColumns(
        {
            "flag_coded_species": F.col("species_coded") >= MIN_CODED_SPECIES,
            "flag_confirmed_pct": F.col("confirmed_pct") >= MIN_CONFIRMED_SHARE,
            "flag_possible_pct": F.col("possible_pct") < MAX_POSSIBLE_SHARE,
            "flag_coded_atlas_comparison": F.col("pba3_pba2_coded_count_compare_pct") >= MIN_CODED_VS_OLD_ATLAS,
            "flag_20_effort_hours": F.col("duration_hours_total") >= MIN_EFFORT_HOURS,
            "flag_breeeding_season_coverage": F.col("breeding_season_months_covered") >= MIN_BREEDING_MONTHS,
            "flag_nocturnal_coverage": (F.col("nocturnal_species_coded") >= MIN_NOCTURNAL_SPECIES)
            | (F.col("duration_hours_nocturnal") >= MIN_NOCTURNAL_HOURS),
        }
    )
    all_ok = F.col(FLAGS[0])
    for f in FLAGS[1:]:
        all_ok = all_ok & F.col(f)
    s = s.orderBy(*[F.col(c).asc_nulls_last() for c in ("block_region", "block_county", "block_name") if c in s.columns])
    return s.select("pba3_block", "block_name", "block_county", all_ok.alias("all_criteria_complete"), *FLAGS)


def progress_table(summary: DataFrame, season: str) -> DataFrame:
    """One season's summary without season / nested columns, by region, county, name (NULL last)."""
    out = dashboard_summary(summary).where(F.col("season") == season).drop("season", "effort_breakdown")
    return out.orderBy(
        F.col("block_region").asc_nulls_last(), F.col("block_county").asc_nulls_last(), F.col("block_name").asc_nulls_last()
    )


def map_values(summary: DataFrame, season: str, variable: str) -> DataFrame:
    """(pba3_block, value) of one summary variable in one season, for the block map."""
    return dashboard_summary(summary).where(F.col("season") == season).select("pba3_block", F.col(variable).alias("value"))


def report_effort(summary: DataFrame, block_id: str, season: str) -> DataFrame:
    """Effort hours of one block and season as a long table, rounded half-to-even to 2 places."""
    one = summary.where((F.col("pba3_block") == block_id) & (F.col("season") == season)).select(
        F.col("duration_hours_total").alias("Total"),
        F.col("duration_hours_diurnal").alias("Diurnal"),
        F.col("duration_hours_nocturnal").alias("Nocturnal"),
        F.col("duration_hours_unknown").alias("Unknown"),
    )
    long = pivot_longer(one, [], "Effort type", "Value")
    return long.withColumn("Value", F.bround("Value", 2))


def report_codes(summary: DataFrame, block_id: str, season: str) -> DataFrame:
    """Species counts by highest category of one block and season, long."""
    one = summary.where((F.col("pba3_block") == block_id) & (F.col("season") == season)).select(
        *[F.col(c).cast("long").alias(c) for c in ["Confirmed", "Probable", "Possible", "Observed"]]
    )
    return pivot_longer(one, [], "Code", "Count")


def with_link(df: DataFrame, base_url: str, id_col: str = "pba3_block", link_col: str = "link") -> DataFrame:
    """Link column ``base_url + id`` (NULL id: NULL link)."""
    return df.withColumn(link_col, F.concat(F.lit(base_url), F.col(id_col)))


def checklist_density(obs: DataFrame, block_id: str, season: str) -> DataFrame:
    """Checklists per coordinate in one block and season (filter pushed to the scan)."""
    one = season_fanout(obs.where(F.col("pba3_block") == block_id), season)
    return (
        one.select("checklist_id", "longitude", "latitude")
        .distinct()
        .groupBy("longitude", "latitude")
        .agg(F.count(F.lit(1)).alias("checklist_count"))
    )


def region_hierarchy(summary: DataFrame) -> DataFrame:
    """Region -> sorted list of (block_name, pba3_block) for the block picker."""
    d = summary.select("block_region", "pba3_block", "block_name").distinct().where(
        F.col("block_region") != "Unknown region"
    )
    return d.groupBy("block_region").agg(
        F.sort_array(F.collect_list(F.struct("pba3_block", "block_name"))).alias("blocks")
    )


def region_blocks(summary: DataFrame) -> DataFrame:
    """Flat form of the hierarchy: distinct (region, block, name) without the unknown region."""
    return (
        summary.select("block_region", "pba3_block", "block_name")
        .distinct()
        .where(F.col("block_region") != "Unknown region")
    )


def focal_match(focal: DataFrame, obs: DataFrame) -> DataFrame:
    """Focal species never observed, and observed species not on the focal list."""
    seen = obs.select("common_name").distinct()
    f = focal.select("common_name").distinct()
    return union_rows(
        anti_join(f, seen, ["common_name"]).withColumn("side", F.lit("focal_not_observed")),
        anti_join(seen, f, ["common_name"]).withColumn("side", F.lit("observed_not_focal")),
    )
