"""Season fan-out (C6) and the block × season summary (C9, the flagship).

The reference filters the observations once per season and runs eight
branches per season (about 24 scans). Here two grains are aggregated from the
observations once, and the summary keeps their partitioning: the checklist
grain is hashed by checklist once, every aggregate of a checklist (start
repair, place, duration) reuses that, and the season fan-out is a narrow step
on the aggregated rows (``per_season``). The rows of all branches meet in one
aggregate by (season, block), which combines map-side. The single branches are
also there as functions of a fanned-out table (``season_fanout``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import MONTH_ABB, n_distinct, sum0
from blockwise.operators.joins import combine_by_key, join_on, lookup, semi_join, union_rows
from blockwise.operators.reshape import explode_delimited
from blockwise.plans.clean import apply_start_fix, modal_start_times
from blockwise.plans.effort import CLASSES, add_day_night_class, effort_by_date, nest_effort
from blockwise.plans.lookups import ALL_SEASONS, BREEDING, CODED_CLASSES, SEASON_MONTHS, breeding_lookup, seasons
from blockwise.session import LOCAL_TZ, materialize

KEYS = ["season", "pba3_block"]


def season_fanout(obs: DataFrame, season: str | None = None, month_col: str = "observation_month_num") -> DataFrame:
    """Each row once per season containing its month (inner join on month number)."""
    s = seasons(obs.sparkSession)
    if season is not None:
        s = s.where(F.col("season") == season)
    s = s.select("season", F.col("month_num").alias(month_col))
    return obs.join(F.broadcast(s), on=month_col, how="inner")


def per_season(
    grain: DataFrame,
    keys: list[str],
    aggs: dict,
    season: str | None = None,
    transform=None,
    month_col: str = "observation_month_num",
) -> DataFrame:
    """(season, keys..., aggregates): same rows as fanning ``grain`` out to seasons and aggregating per (season, keys).

    One aggregate by ``keys`` with one set of conditional aggregates per season
    (``aggs``: name -> function from a condition to an aggregate column); the
    seasons become rows after it, so the shuffle sees un-fanned rows, and none
    happens at all if ``grain`` is partitioned by some of the keys. The
    aggregates stay plain columns up to there: list functions would leave
    generated code. ``transform`` (e.g. the day/night class) is applied to the
    rows of the seasons.
    """
    months = {s: [MONTH_ABB.index(m) + 1 for m in ms] for s, ms in SEASON_MONTHS.items() if season in (None, s)}
    here = {s: F.coalesce(F.col(month_col).isin(nums), F.lit(False)) for s, nums in months.items()}
    flat = [a for i, c in enumerate(here.values()) for a in (F.bool_or(c).alias(f"__t{i}"), *[f(c).alias(f"__{n}{i}") for n, f in aggs.items()])]
    rows = [F.struct(F.lit(s).alias("season"), F.col(f"__t{i}").alias("__there"), *[F.col(f"__{n}{i}").alias(n) for n in aggs]) for i, s in enumerate(here)]
    per = grain.groupBy(*keys).agg(*flat).select(*keys, F.inline(F.array(*rows))).where("__there")
    per = per.select("season", *keys, *aggs)
    return per if transform is None else transform(per)


def checklist_count(fan: DataFrame) -> DataFrame:
    return fan.groupBy(*KEYS).agg(n_distinct("checklist_id").alias("checklist_count"))


def species_observed(fan: DataFrame) -> DataFrame:
    return fan.groupBy(*KEYS).agg(n_distinct("common_name").alias("species_observed"))


def birders(fan: DataFrame) -> DataFrame:
    """Distinct observers after splitting the comma list (distinct first shrinks the shuffle)."""
    people = explode_delimited(fan.select(*KEYS, "observer_id").distinct(), "observer_id", ",")
    return people.groupBy(*KEYS).agg(n_distinct("observer_id").alias("birders"))


def effort_two_level(fan: DataFrame) -> DataFrame:
    """Longest duration and distance per checklist, then summed per block (hours, km)."""
    per = fan.groupBy(*KEYS, "checklist_id").agg(
        F.max("duration_minutes").alias("d"), F.max("effort_distance_km").alias("k")
    )
    return per.groupBy(*KEYS).agg(
        (sum0("d") / 60).alias("duration_hours_total"), sum0("k").alias("effort_distance_km")
    )


def species_by_max_category(fan: DataFrame, strict: bool = False) -> DataFrame:
    """Species counted under their highest category, wide (Observed … Confirmed; absent NULL).

    ``strict`` follows R's ``max`` without ``na.rm``: a species with an unknown
    rank is dropped (T4).
    """
    m = F.max("breeding_rank")
    if strict:
        m = F.when(F.count_if(F.col("breeding_rank").isNull()) > 0, F.lit(None)).otherwise(m)
    top = fan.groupBy(*KEYS, "common_name").agg(m.alias("breeding_rank")).where(F.col("breeding_rank").isNotNull())
    named = lookup(top, breeding_lookup(fan.sparkSession).select("breeding_rank", "breeding_category_desc"), ["breeding_rank"])
    return named.groupBy(*KEYS).pivot("breeding_category_desc", CODED_CLASSES).agg(F.count(F.lit(1)))


def season_coverage(fan: DataFrame, breeding: str = BREEDING) -> DataFrame:
    """Breeding-season months with a dated checklist (month of the start datetime)."""
    s = seasons(fan.sparkSession).where(F.col("season") == breeding).select(F.col("month_num").alias("m"))
    months = fan.select(*KEYS, F.month("observation_datetime").alias("m")).distinct()
    return (
        months.join(F.broadcast(s), "m", "inner")
        .groupBy(*KEYS)
        .agg(n_distinct("m").alias("breeding_season_months_covered"))
    )


def nocturnal_coded(fan: DataFrame, nocturnal: DataFrame, min_rank: int = 2) -> DataFrame:
    """Nocturnal priority species coded at rank >= ``min_rank``; every block present, 0-filled."""
    coded = semi_join(fan.where(F.col("breeding_rank") >= min_rank), nocturnal, ["common_name"])
    counts = coded.groupBy(*KEYS).agg(n_distinct("common_name").alias("nocturnal_species_coded"))
    blocks = fan.select(*KEYS).distinct()
    return join_on(blocks, counts, KEYS, "left", null_safe=True).withColumn(
        "nocturnal_species_coded", F.coalesce(F.col("nocturnal_species_coded"), F.lit(0))
    )


CHECKLIST_GRAIN = [
    "pba3_block",
    "checklist_id",
    "observer_id",
    "longitude",
    "latitude",
    "observation_month_num",
    "observation_datetime",
]
SPECIES_GRAIN = ["pba3_block", "common_name", "observation_month_num", "breeding_rank", "breeding_category_desc"]


def checklist_grain(obs: DataFrame) -> DataFrame:
    """Observations collapsed to one row per (block, checklist, observers, place, month, start).

    Carries the longest duration and distance. Every checklist-level metric of
    the summary (counts, effort, day/night, coverage, birders, start-time
    repair) is exact on this table, and it is one partial aggregate of the
    observation scan — species rows never reach the season fan-out.
    """
    return obs.groupBy(*CHECKLIST_GRAIN).agg(
        F.max("duration_minutes").alias("duration_minutes"), F.max("effort_distance_km").alias("effort_distance_km")
    )


def species_grain(obs: DataFrame) -> DataFrame:
    """Distinct (block, species, month, rank, category): feeds every species-level metric."""
    return obs.select(*SPECIES_GRAIN).distinct()


def _when_max(column: str):
    return lambda here: F.max(F.when(here, F.col(column)))


def species_rows(
    sg: DataFrame, nocturnal: DataFrame, min_rank: int = 2, strict: bool = False, season: str | None = None
) -> DataFrame:
    """(season, block, species, r, coded_nocturnal): the highest rank of a species, and whether it counts as nocturnal.

    The nocturnal list is a species list (bounded by the taxonomy), joined as a
    flag. ``strict`` follows R's ``max`` without ``na.rm`` (T4).
    """
    top = _when_max("breeding_rank")
    if strict:
        rank = F.col("breeding_rank")
        aggs = {"r": lambda here: F.when(F.count_if(here & rank.isNull()) == 0, F.max(F.when(here, rank)))}
    else:
        aggs = {"r": top}
    per = per_season(sg, ["pba3_block", "common_name"], aggs, season)
    noct = nocturnal.select("common_name").distinct().withColumn("__noct", F.lit(True))
    flagged = per.join(noct, "common_name", "left")
    return flagged.select(*KEYS, "common_name", "r", (F.col("__noct") & (F.col("r") >= min_rank)).alias("coded_nocturnal"))


def checklist_rows(cg: DataFrame, season: str | None = None) -> DataFrame:
    """(season, block, checklist, d, k, dated): longest duration and distance, and the months of its starts as bits."""
    month_bit = F.expr("shiftleft(1, month(observation_datetime))")
    aggs = {"d": _when_max("duration_minutes"), "k": _when_max("effort_distance_km"), "dated": lambda here: F.bit_or(F.when(here, month_bit))}
    return per_season(cg, ["pba3_block", "checklist_id"], aggs, season)


def place_rows(cg: DataFrame, season: str | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """(season, block, checklist, place, start, duration, class); ``cg`` has repaired starts."""
    aggs = {
        "observation_datetime": lambda here: F.min(F.when(here, F.col("observation_datetime"))),
        "duration_minutes": lambda here: F.coalesce(F.max(F.when(here, F.col("duration_minutes"))), F.lit(0.0)).cast("double"),
    }
    keys = ["pba3_block", "checklist_id", "longitude", "latitude"]
    return per_season(cg, keys, aggs, season, transform=lambda d: add_day_night_class(d, tz))


def birder_rows(cg: DataFrame, season: str | None = None) -> DataFrame:
    """(season, block, observer): each person once, a missing list being one person."""
    people = explode_delimited(cg.select("pba3_block", "observer_id", "observation_month_num").distinct(), "observer_id", ",")
    return per_season(people, ["pba3_block", "observer_id"], {"one": lambda here: F.max(F.lit(1))}, season).drop("one")


def block_season_metrics(
    obs: DataFrame | None,
    nocturnal: DataFrame,
    fixed: DataFrame | None = None,
    season: str | None = None,
    tz: str = LOCAL_TZ,
    nested: bool = True,
    strict: bool = False,
    grains: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """All per (season, block) metrics of the summary, before names and atlas metrics.

    The checklist grain is hashed by checklist once; start repair, checklist
    rows and place rows reuse that partitioning, so nothing is exchanged until
    all branches are stacked and meet in one aggregate by (season, block) with
    map-side combine. ``grains`` passes the grains in already built (e.g.
    materialized once).
    """
    c_grain, s_grain = grains if grains is not None else (checklist_grain(obs), species_grain(obs))
    by_checklist = c_grain.repartition("checklist_id")
    # The repaired start counts for the day/night class only; coverage keeps
    # the reported starts, as the reference does.
    repaired = apply_start_fix(by_checklist, modal_start_times(by_checklist) if fixed is None else fixed)
    places = place_rows(repaired, season, tz)
    rows = union_rows(
        checklist_rows(by_checklist, season).select(*KEYS, F.lit("checklist").alias("branch"), "d", "k", "dated"),
        places.select(*KEYS, F.col("checklist_type").alias("branch"), F.col("duration_minutes").alias("d")),
        species_rows(s_grain, nocturnal, strict=strict, season=season).select(*KEYS, F.lit("species").alias("branch"), "r", "coded_nocturnal"),
        birder_rows(c_grain, season).select(*KEYS, F.lit("birder").alias("branch")),
    )
    branch, r = F.col("branch"), F.col("r")
    breeding = sum(1 << (MONTH_ABB.index(m) + 1) for m in SEASON_MONTHS[BREEDING])
    covered = F.bit_count(F.bit_or(F.col("dated")).bitwiseAND(breeding)).cast("long")
    out = rows.groupBy(*KEYS).agg(
        F.count_if(branch == "checklist").alias("checklist_count"),
        (sum0(F.when(branch == "checklist", F.col("d"))) / 60).alias("duration_hours_total"),
        sum0("k").alias("effort_distance_km"),
        F.count_if(branch == "species").alias("species_observed"),
        *[
            F.when(F.count_if(r == rank) > 0, F.count_if(r == rank)).alias(name)
            for rank, name in enumerate(CODED_CLASSES, start=1)
        ],
        F.count_if("coded_nocturnal").alias("nocturnal_species_coded"),
        F.count_if(branch == "birder").alias("birders"),
        *[(sum0(F.when(branch == c, F.col("d"))) / 60).alias(f"duration_hours_{c}") for c in CLASSES],
        F.when(covered > 0, covered).alias("breeding_season_months_covered"),
    )
    if not nested:
        return out
    breakdown = nest_effort(effort_by_date(places, ["season"]), ["season"])
    return combine_by_key([out, breakdown], KEYS)


SUMMARY_COLUMNS = [
    "pba3_block",
    "block_name",
    "block_region",
    "block_county",
    "season",
    "species_observed",
    *CODED_CLASSES,
    "checklist_count",
    "birders",
    "duration_hours_total",
    "duration_hours_diurnal",
    "duration_hours_nocturnal",
    "duration_hours_unknown",
    "effort_distance_km",
    "pct_missing_pba2_confirmations",
    "pct_coded_atlas_comparison",
    "pba3_pba2_coded_count_compare_pct",
    "breeding_season_months_covered",
    "nocturnal_species_coded",
]


def with_block_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Left join the name lookup and default missing names (T21: county defaulted too)."""
    out = join_on(df, names, ["pba3_block"], "left", null_safe=True)
    return out.withColumns(
        {
            "block_name": F.coalesce("block_name", F.lit("Unknown block name")),
            "block_region": F.coalesce("block_region", F.lit("Unknown region")),
            "block_county": F.coalesce("block_county", F.lit("Unknown county")),
        }
    )


def summary_grains(obs: DataFrame, persist: bool = True) -> tuple[DataFrame, DataFrame]:
    """(checklist grain, species grain), written once to the shared checkpoint folder.

    At scale these are a small fraction of the observations and are read by
    every branch, the start-time repair and the atlas comparison.
    """
    cg, sg = checklist_grain(obs), species_grain(obs)
    if not persist:
        return cg, sg
    return materialize(cg, "checklist-grain"), materialize(sg, "species-grain")


def block_season_summary(
    obs: DataFrame | None,
    nocturnal: DataFrame,
    names: DataFrame,
    atlas_metrics: DataFrame | None = None,
    fixed: DataFrame | None = None,
    season: str | None = None,
    tz: str = LOCAL_TZ,
    nested: bool = True,
    grains: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Block × season summary with names and (for "All seasons") atlas comparison metrics."""
    m = block_season_metrics(obs, nocturnal, fixed, season, tz, nested, grains=grains)
    if atlas_metrics is not None:
        am = atlas_metrics.select(
            "pba3_block",
            "pct_missing_pba2_confirmations",
            "pct_coded_atlas_comparison",
            "pba3_pba2_coded_count_compare_pct",
        ).withColumn("season", F.lit(ALL_SEASONS))
        m = join_on(m, am, KEYS, "left", null_safe=True)
    else:
        m = m.withColumns(
            {
                "pct_missing_pba2_confirmations": F.lit(None).cast("double"),
                "pct_coded_atlas_comparison": F.lit(None).cast("double"),
                "pba3_pba2_coded_count_compare_pct": F.lit(None).cast("double"),
            }
        )
    out = with_block_names(m, names)
    cols = SUMMARY_COLUMNS + (["effort_breakdown"] if nested else [])
    return out.select(*cols)


def summary_with_polygons(
    polygons: DataFrame, summary: DataFrame, block: str = "pba3_block", null_safe: bool = False
) -> DataFrame:
    """Old-atlas polygons (with their new block id from the crosswalk) left-joined to the summary.

    Every polygon is kept; a polygon with several seasons gets one row per
    season. ``null_safe=True`` copies dplyr's NULL-matching join (T1): every
    polygon without a new block then takes the summary of the NULL block, if
    there is one. The default matches only real block ids.
    """
    return join_on(polygons, summary, [block], "left", null_safe=null_safe)
