"""Registered queries: (spark, sf_dir) -> DataFrame over the driver's test tables.

Each key has a DuckDB twin in ``blockwise.oracle_queries`` unless it is a
rows-only check (random samples, nested output, iterative fits, geometry).
Doubles are rounded to 6 places in the registered form only, so the oracle
comparison is not thrown by summation order; library functions never round.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.plans import compare as cmp
from blockwise.plans.clean import modal_start_times
from blockwise.plans.season import block_season_summary, checklist_grain, species_grain, summary_grains
from blockwise.session import materialize
from blockwise.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ROWS_ONLY: set[str] = set()


def register(name: str, rows_only: bool = False):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        if rows_only:
            ROWS_ONLY.add(name)
        return fn

    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round double columns to 6 places (presentation for the oracle check)."""
    return df.select(
        [
            F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ---------------------------------------------------------------- shared inputs


def obs(spark, sf):
    return fx.observations(spark, sf)


_SPECIES: WeakKeyDictionary[SparkSession, dict[str, list[str]]] = WeakKeyDictionary()


def species_list(spark, sf) -> list[str]:
    """Distinct species names (bounded by the species count) as the pivot value list."""
    known = _SPECIES.setdefault(spark, {})
    if sf not in known:
        known[sf] = sorted(r[0] for r in fx.table(spark, sf, "part").select("p_name").distinct().collect())
    return known[sf]


def old_atlas(spark, sf, rows=None):
    wide = fx.old_atlas_wide(spark, sf, species_list(spark, sf), rows)
    return cmp.old_atlas_from_matrix(wide, ["pba3_block", "block_name"])


def compare_table(spark, sf, o=None):
    o = obs(spark, sf) if o is None else o
    return cmp.atlas_compare(old_atlas(spark, sf), cmp.new_atlas_max(species_grain(o)), fx.block_names(spark, sf))


def summary(spark, sf, nested: bool = False, season: str | None = None):
    # Both grains and the old atlas read one join, made once.
    rows = materialize(fx.joined_rows(spark, sf), "joined-rows")
    cg, sg = summary_grains(fx.observations(spark, sf, rows))
    compare = cmp.atlas_compare(old_atlas(spark, sf, rows), cmp.new_atlas_max(sg), fx.block_names(spark, sf))
    return block_season_summary(
        None,
        fx.nocturnal_species(spark, sf),
        fx.block_names(spark, sf),
        atlas_metrics=cmp.atlas_block_metrics(compare),
        season=season,
        nested=nested,
        grains=(cg, sg),
    )


# ---------------------------------------------------------------- flagship


@register("block_season_summary")
def q_block_season_summary(spark, sf):
    return r6(summary(spark, sf))


# ---------------------------------------------------------------- helpers for keys

import uuid  # noqa: E402

from blockwise.functions import semantics as S  # noqa: E402
from blockwise.functions.sun import sun_events_local  # noqa: E402
from blockwise.operators import aggregate as A  # noqa: E402
from blockwise.operators import joins as J  # noqa: E402
from blockwise.operators import reshape as R  # noqa: E402
from blockwise.operators import sampling as O  # noqa: E402
from blockwise.plans import calendar as CAL  # noqa: E402
from blockwise.plans import clean as CL  # noqa: E402
from blockwise.plans import effort as EF  # noqa: E402
from blockwise.plans import expected as EX  # noqa: E402
from blockwise.plans import quality as QC  # noqa: E402
from blockwise.plans import reports as RP  # noqa: E402
from blockwise.plans import season as SE  # noqa: E402
from blockwise.plans import spatial as SP  # noqa: E402
from blockwise.plans import stats as ST  # noqa: E402
from blockwise.plans.lookups import calendar_glossary  # noqa: E402
from blockwise.plans.lookups import seasons as seasons_df  # noqa: E402
from blockwise.session import ensure_checkpoint_dir, materialize  # noqa: E402
from blockwise.sources import io as IO  # noqa: E402

REPORT_BLOCK = "B3"
MISSING_BLOCK = "B21"
REPORT_SEASON = "Breeding"
CAL_START = "Jun"
SAFE_YEAR = 2025


def scratch(spark: SparkSession, tag: str) -> str:
    """Fresh folder under the shared checkpoint directory (never a machine-local temp dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def fan(spark, sf):
    return SE.season_fanout(obs(spark, sf))


def calendar(spark, sf):
    return CAL.calendar_build(fx.calendar_raw(spark, sf))


def classified(spark, sf):
    o = obs(spark, sf)
    return EF.classify_checklists(o, CL.modal_start_times(o))


# ---------------------------------------------------------------- 2.1 sources and sinks


@register("scan_parquet")
def q_scan_parquet(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.where((F.col("l_suppkey") % 20 == 3) & (F.col("l_quantity") >= 40)).select(
        "l_orderkey", "l_partkey", "l_quantity"
    )


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    path = scratch(spark, "csv")
    src = fx.raw_observations(spark, sf).select("atlas_block", "checklist_id", "common_name", "observation_count")
    IO.write_csv_text(src, path)
    return IO.read_csv(spark, path, "atlas_block string, checklist_id string, common_name string, observation_count string")


@register("extract_filter")
def q_extract_filter(spark, sf):
    schema = (
        "atlas_block string, checklist_id string, common_name string, observation_date date, "
        "duration_minutes double, project_names string"
    )
    path = scratch(spark, "extract")
    src = fx.raw_observations(spark, sf).select(*[c.split()[0] for c in schema.split(", ")])
    names = {c: c.upper().replace("_", " ") for c in reversed(src.columns)}
    mixed = src.select(F.lit("x").alias("LAST EDITED DATE"), *[F.col(c).alias(n) for c, n in names.items()], F.lit(1).alias("OTHER"))
    mixed.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return IO.read_extract(spark, path, schema, start="1996-01-01", end="1997-06-30", project="Atlas")


@register("parquet_roundtrip")
def q_parquet_roundtrip(spark, sf):
    """Summary written by season and read back; the nested breakdown as rows with their places in the list."""
    path = scratch(spark, "summary")
    IO.write_parquet(summary(spark, sf, nested=True), path, partition_by=["season"])
    back = IO.read_parquet(spark, path).select("season", "pba3_block", "checklist_count", F.posexplode("effort_breakdown").alias("place", "e"))
    return r6(back.select("season", "pba3_block", "checklist_count", F.col("place").cast("long").alias("place"), "e.*"))


@register("release_tag")
def q_release_tag(spark, sf):
    """Release tags of the file names that each part would be delivered in; every other name has none."""
    o = fx.table(spark, sf, "orders")
    month = F.element_at(F.array(*[F.lit(m) for m in S.MONTH_ABB]), F.month("o_orderdate"))
    name = F.concat(F.lit("data/ebd_rel"), month, F.lit("-"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, ".csv").otherwise(".txt"))
    return IO.release_tag(o.select(name.alias("path")).distinct())


EXTRACT_SCHEMA = (
    "atlas_block string, sampling_event_identifier string, group_identifier string, observer_id string, common_name string, "
    "breeding_category string, breeding_code string, observation_date date, time_observations_started string, "
    "duration_minutes double, project_names string"
)


def write_extract(spark, sf) -> str:
    """A delivered extract: shuffled columns in capitals, further columns, durations that are no numbers."""
    path = scratch(spark, "extract")
    number = F.substring("checklist_id", 2, 20).cast("long")
    src = fx.raw_observations(spark, sf).withColumns(
        {
            "group_identifier": F.when(number % 3 != 0, F.concat(F.lit("G"), number.cast("string"))),
            "sampling_event_identifier": F.concat_ws("_", "checklist_id", "atlas_block"),
            "duration_minutes": F.when(F.col("atlas_block") == "B7", F.lit("n/a")).otherwise(F.col("duration_minutes").cast("string")),
        }
    )
    names = [c.split()[0] for c in EXTRACT_SCHEMA.split(", ")][::-1]
    given = [F.col(c).alias(c.upper().replace("_", " ")) for c in names]
    src = src.select(F.lit("x").alias("LAST EDITED DATE"), *given[:5], F.col("longitude").alias("LONGITUDE"), *given[5:])
    src.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return path


@register("extract_pipeline")
def q_extract_pipeline(spark, sf):
    """Extract -> filter -> one row per checklist and species -> clean -> rank."""
    raw = IO.read_extract(spark, write_extract(spark, sf), EXTRACT_SCHEMA, start="1996-01-01", end="1997-06-30", project="Atlas")
    out = CL.with_breeding_rank(CL.clean_observations(CL.collapse_shared(raw)))
    return r6(
        out.select(
            "checklist_id", "common_name", "observer_id", "first_event_id", "pba3_block", "breeding_category", "breeding_rank",
            "observation_date", "observation_month", "observation_datetime", "duration_minutes",
        )
    )


@register("bad_cells")
def q_bad_cells(spark, sf):
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    return IO.bad_cells(reader, write_extract(spark, sf), EXTRACT_SCHEMA)


@register("csv_positional")
def q_csv_positional(spark, sf):
    """Files with three leading lines that are no data, read by position."""
    path = scratch(spark, "positional")
    src = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    rows = src.repartition(5, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.concat_ws(",", "o_orderkey", "o_custkey", "day").alias("line"))

    def headed(batches):
        import pyarrow as pa

        lines = ["delivered,by,hand", "o_orderkey,o_custkey,day", "number,number,date"]
        for batch in batches:
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], schema=batch.schema)
                lines = []
            yield batch

    rows.mapInArrow(headed, "line string").write.text(path)
    return IO.read_csv_positional(spark, path, ["order_id", "customer", "day"], skip=3)


@register("partition_refresh")
def q_partition_refresh(spark, sf):
    """A summary stored by season, of which one season is written anew: (season, rows, files) and whether its files are the old ones."""
    path = scratch(spark, "seasons")
    counts = SE.checklist_count(fan(spark, sf))
    IO.write_parquet(counts, path, ["season"])
    files = lambda: IO.read_parquet(spark, path).select("season", F.col("_metadata.file_path").alias("file")).distinct()
    before = materialize(files(), "files-before")
    IO.write_parquet(counts.where(F.col("season") == "Winter").withColumn("checklist_count", -F.col("checklist_count")), path, ["season"], refresh=True)
    kept = files().join(before, ["season", "file"], "left_semi").groupBy("season").agg(F.lit(True).alias("same_files"))
    rows = IO.read_parquet(spark, path).groupBy("season").agg(F.count(F.lit(1)).alias("blocks"), F.sum("checklist_count").alias("checklists"))
    return rows.join(kept, "season", "left").select("season", "blocks", "checklists", F.coalesce("same_files", F.lit(False)).alias("same_files"))


@register("blocks_source")
def q_blocks_source(spark, sf):
    path = scratch(spark, "polys")
    sq = fx.grid_squares(obs(spark, sf))
    sq.select("pba2_block", F.transform("ring", lambda p: F.array(p.x, p.y)).alias("ring")).write.mode(
        "overwrite"
    ).json(path)
    read = IO.read_polygons_json(spark, path, "pba2_block")
    return r6(read.select("pba2_block", F.posexplode("ring").alias("place", "p")).select("pba2_block", F.col("place").cast("long").alias("place"), "p.*"))


# ---------------------------------------------------------------- 2.2 projection, filter, reshape


@register("select_reorder")
def q_select_reorder(spark, sf):
    return r6(
        R.select_matching(
            obs(spark, sf), first=["checklist_id", "pba3_block"], starts_with="breeding", contains="month",
            any_of=["longitude", "no_such_column"], drop=["observation_month_num"],
        )
    )


@register("rename_fn")
def q_rename_fn(spark, sf):
    o = obs(spark, sf).select("checklist_id", "observation_date", "observation_month", "observation_count")
    return R.rename_with(o, R.str_remove_fn("observation_"), lambda c: "observation" in c)


@register("rename_positional")
def q_rename_positional(spark, sf):
    o = obs(spark, sf).select("pba3_block", "checklist_id", "common_name").distinct()
    return R.rename_positional(o, {1: "block", 3: "species"})


@register("across_round")
def q_across_round(spark, sf):
    s = summary(spark, sf).select("season", "pba3_block", "duration_hours_total", "effort_distance_km")
    return R.across(s, ["duration_hours_total", "effort_distance_km"], lambda c: F.bround(c, 2))


@register("filter_predicates")
def q_filter_predicates(spark, sf):
    o = obs(spark, sf)
    cond = ((F.col("breeding_rank") >= 3) & F.col("pba3_block").isin("B1", "B2")) | (
        F.col("observation_datetime").isNull() & ~(F.col("protocol_name") == "Traveling")
    )
    return o.where(cond).select("checklist_id", "common_name", "pba3_block", "breeding_rank", "protocol_name")


@register("calendar_exclude_blank")
def q_calendar_exclude_blank(spark, sf):
    cal, _ = calendar(spark, sf)
    return CAL.calendar_view(cal, None, exclude_blank=True, show_priority=True)


@register("drop_na")
def q_drop_na(spark, sf):
    return obs(spark, sf).na.drop(subset=["observation_datetime"]).select("checklist_id", "observation_datetime").distinct()


@register("fill_na")
def q_fill_na(spark, sf):
    raw = fx.raw_observations(spark, sf).select("checklist_id", "common_name", "breeding_category", "observation_count")
    return raw.na.fill({"breeding_category": "C1", "observation_count": "0"})


@register("unpivot_weeks")
def q_unpivot_weeks(spark, sf):
    cal, _ = calendar(spark, sf)
    return CAL.calendar_long(cal).drop("week_index")


@register("pivot_codes")
def q_pivot_codes(spark, sf):
    return SE.species_by_max_category(fan(spark, sf))


@register("explode_delimited")
def q_explode_delimited(spark, sf):
    o = obs(spark, sf).select("pba3_block", "observer_id").distinct()
    return R.explode_delimited(o, "observer_id").distinct()


@register("nest_effort")
def q_nest_effort(spark, sf):
    nested = EF.nest_effort(EF.effort_by_date(classified(spark, sf)))
    flat = nested.select("pba3_block", F.size("effort_breakdown").cast("long").alias("days"), F.posexplode("effort_breakdown").alias("place", "e"))
    return r6(flat.select("pba3_block", "days", F.col("place").cast("long").alias("place"), "e.*"))


@register("unnest_effort")
def q_unnest_effort(spark, sf):
    return r6(R.unnest(EF.nest_effort(EF.effort_by_date(classified(spark, sf))), "effort_breakdown"))


@register("complete_grid")
def q_complete_grid(spark, sf):
    o = obs(spark, sf)
    confirmed = o.where(F.col("breeding_rank") == 4).groupBy("pba3_block").agg(
        S.n_distinct("common_name").alias("confirmed_species")
    )
    return R.complete_values(confirmed, "pba3_block", fx.block_names(spark, sf), {"confirmed_species": 0})


@register("complete_keys")
def q_complete_keys(spark, sf):
    counts = A.count_by(obs(spark, sf), ["common_name", "observation_month_num", "breeding_category"])
    return R.complete_keys(counts, "common_name", ["observation_month_num", "breeding_category"], {"n": 0})


# ---------------------------------------------------------------- 2.3 joins


@register("left_join_lookup")
def q_left_join_lookup(spark, sf):
    blocks = obs(spark, sf).select("pba3_block").distinct()
    return SE.with_block_names(blocks, fx.block_names(spark, sf))


@register("left_join_multi")
def q_left_join_multi(spark, sf):
    o = obs(spark, sf)
    per = o.groupBy("pba3_block", "checklist_id", "longitude", "latitude").agg(
        F.min("observation_datetime").alias("observation_datetime")
    )
    return r6(J.join_on(per, EF.sun_times(o), ["longitude", "latitude", "observation_datetime"], "left"))


@register("inner_join_season")
def q_inner_join_season(spark, sf):
    months = obs(spark, sf).select("pba3_block", F.col("observation_month").alias("m")).distinct()
    s = seasons_df(spark).withColumnRenamed("month", "m")
    return months.join(F.broadcast(s), "m", "inner").select("pba3_block", "season", F.col("m").alias("month"))


@register("semi_join_season")
def q_semi_join_season(spark, sf):
    o = obs(spark, sf)
    b = J.semi_join(o, seasons_df(spark).where(F.col("season") == "Breeding"), ["observation_month"], ["month"])
    return A.count_by(b, ["pba3_block"])


@register("anti_join_blocks")
def q_anti_join_blocks(spark, sf):
    return QC.keys_missing_both_ways(old_atlas(spark, sf), obs(spark, sf), "pba3_block", "old", "new")


@register("join_null_safe")
def q_join_null_safe(spark, sf):
    o = obs(spark, sf).select("checklist_id", "observation_datetime").distinct()
    per_dt = A.count_by(o, ["observation_datetime"], "n_checklists")
    return J.join_on(o, per_dt, ["observation_datetime"], "left", null_safe=True)


@register("spatial_covers")
def q_spatial_covers(spark, sf):
    o = obs(spark, sf)
    pts = o.select("checklist_id", F.col("longitude").alias("px"), F.col("latitude").alias("py")).distinct()
    polys = fx.grid_squares(o).unionByName(fx.slanted_polygons(o))
    return r6(SP.covers_join(polys, pts).drop("ring"))


@register("full_outer_compare")
def q_full_outer_compare(spark, sf):
    return compare_table(spark, sf)


@register("season_glossary")
def q_season_glossary(spark, sf):
    """Calendar codes with the meaning that the legend gives them."""
    cal, _ = calendar(spark, sf)
    codes = A.count_by(CAL.calendar_long(cal), ["breeding_calendar_code"])
    return J.lookup(codes, calendar_glossary(spark).withColumnRenamed("Season", "breeding_calendar_code"), ["breeding_calendar_code"])


# ---------------------------------------------------------------- 2.4 aggregations


@register("count_by_keys")
def q_count_by_keys(spark, sf):
    return A.count_by(obs(spark, sf), ["breeding_category", "breeding_code"], sort=True)


@register("count_of_counts")
def q_count_of_counts(spark, sf):
    d = obs(spark, sf).select("checklist_id", "observation_datetime").distinct()
    return A.count_of_counts(d, ["checklist_id"])


@register("grouped_summary")
def q_grouped_summary(spark, sf):
    return r6(
        obs(spark, sf)
        .groupBy("pba3_block")
        .agg(
            F.sum("duration_minutes").alias("sum_duration"),
            F.min("observation_date").alias("first_date"),
            F.max("observation_date").alias("last_date"),
            F.avg("effort_distance_km").alias("mean_distance"),
        )
    )


@register("date_range")
def q_date_range(spark, sf):
    return QC.date_range(obs(spark, sf), "observation_date")


@register("effort_two_level")
def q_effort_two_level(spark, sf):
    return r6(SE.effort_two_level(fan(spark, sf)))


@register("n_distinct_nulls")
def q_n_distinct_nulls(spark, sf):
    return obs(spark, sf).groupBy("pba3_block").agg(
        S.n_distinct("observation_datetime").alias("start_times"),
        F.count_distinct("observation_datetime").alias("start_times_non_null"),
    )


@register("count_if_ranks")
def q_count_if_ranks(spark, sf):
    return obs(spark, sf).groupBy("pba3_block").agg(
        F.count_if(F.col("breeding_rank") >= 2).alias("coded_rows"),
        F.count_if(F.col("breeding_rank") == 4).alias("confirmed_rows"),
    )


@register("share_if")
def q_share_if(spark, sf):
    return r6(
        obs(spark, sf).groupBy("pba3_block").agg(F.avg((F.col("breeding_rank") == 4).cast("double")).alias("confirmed_share"))
    )


@register("distinct_keys")
def q_distinct_keys(spark, sf):
    return obs(spark, sf).select("breeding_category", "breeding_code", "breeding_rank").distinct()


@register("modal_value")
def q_modal_value(spark, sf):
    v = fx.visits(spark, sf).withColumn("hour", F.hour("observation_datetime"))
    return A.modal_value(v, ["checklist_id"], "hour", out="modal_hour")


@register("rows_at_group_max")
def q_rows_at_group_max(spark, sf):
    return cmp.new_atlas_max(obs(spark, sf))


@register("region_hierarchy")
def q_region_hierarchy(spark, sf):
    blocks = F.posexplode("blocks").alias("place", "b")
    flat = RP.region_hierarchy(summary(spark, sf)).select("block_region", blocks)
    return flat.select("block_region", F.col("place").cast("long").alias("place"), "b.pba3_block", "b.block_name")


@register("region_blocks")
def q_region_blocks(spark, sf):
    return RP.region_blocks(summary(spark, sf))


@register("rowwise_sum")
def q_rowwise_sum(spark, sf):
    d = EF.effort_by_date(classified(spark, sf))
    return r6(d.select("pba3_block", "observation_date", S.row_sum(*EF.DURATION_COLS).alias("duration_hours_total")))


# ---------------------------------------------------------------- 2.5 windows


@register("week_index")
def q_week_index(spark, sf):
    cal, _ = calendar(spark, sf)
    return CAL.calendar_long(cal).select("common_name", "week", "week_index")


@register("add_count")
def q_add_count(spark, sf):
    d = obs(spark, sf).select("pba3_block", "checklist_id", "duration_minutes", "effort_distance_km").distinct()
    return r6(A.add_count(d, ["checklist_id"]).where(F.col("n") > 1))


# ---------------------------------------------------------------- 2.6 sort, limit, sample


@register("sort_nulls_last")
def q_sort_nulls_last(spark, sf):
    c = compare_table(spark, sf)
    return c.orderBy(S.asc_last("pba3_block"), S.desc_last("pba2_breeding_rank_max"), S.asc_last("common_name"))


@register("top_k")
def q_top_k(spark, sf):
    cc = SE.checklist_count(fan(spark, sf)).where(F.col("season") == "All seasons")
    return O.top_k(cc, 10, [F.col("checklist_count").desc(), F.col("pba3_block").asc()])


@register("sample_prop")
def q_sample_prop(spark, sf):
    keys = ["checklist_id", "common_name", "observer_id", "pba3_block", "observation_date"]
    return O.sample_prop(obs(spark, sf).select(*keys).distinct(), 0.1, keys, seed=7)


@register("sample_per_group")
def q_sample_per_group(spark, sf):
    pts = obs(spark, sf).select("pba3_block", "checklist_id", "longitude", "latitude").distinct()
    return r6(O.sample_per_group(pts, ["pba3_block"], 100, ["checklist_id", "longitude", "latitude"], seed=1))


@register("sample_weighted")
def q_sample_weighted(spark, sf):
    es = EX.eb_shrink_moments(materialize(EX.expected_species(obs(spark, sf)), "expected-species"))
    return r6(O.sample_weighted_prop(es, 0.1, "fitted", ["pba3_block", "common_name", "month_num"], seed=3))


# ---------------------------------------------------------------- 2.7 set operations


@register("union_rows")
def q_union_rows(spark, sf):
    return J.union_rows(
        old_atlas(spark, sf).select("pba3_block", "common_name"),
        cmp.new_atlas_max(obs(spark, sf)).select("pba3_block", "common_name"),
    )


@register("union_distinct")
def q_union_distinct(spark, sf):
    return J.union_distinct(
        old_atlas(spark, sf).select("pba3_block", "common_name"),
        cmp.new_atlas_max(obs(spark, sf)).select("pba3_block", "common_name"),
    )


# ---------------------------------------------------------------- 2.8 scalar functions


@register("str_squish")
def q_str_squish(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", S.squish("text").alias("text_squished"))


@register("str_detect_remove")
def q_str_detect_remove(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.col("text").rlike(r"[0-9]").alias("has_digit"),
        S.remove_first("text", r"[0-9]+").alias("text_first_number_removed"),
        F.col("text").contains("the").alias("has_the"),
    )


@register("concat_nulls")
def q_concat_nulls(spark, sf):
    raw = fx.raw_observations(spark, sf)
    return raw.select(
        "checklist_id",
        F.concat(F.col("observation_date").cast("string"), F.lit(" "), F.col("time_observations_started")).alias("stamp"),
    ).distinct()


@register("recode_map")
def q_recode_map(spark, sf):
    long = fx.old_atlas_long(spark, sf)
    return long.select(
        "pba3_block", "species", cmp.recode("category", {"Observed/Possible": "Observed"}).alias("category")
    )


@register("parse_number")
def q_parse_number(spark, sf):
    raw = fx.raw_observations(spark, sf).select("observation_count").distinct()
    return r6(raw.select("observation_count", S.parse_number("observation_count").alias("count_value")))


@register("month_label")
def q_month_label(spark, sf):
    return obs(spark, sf).select("observation_month_num", "observation_month").distinct()


@register("year_month")
def q_year_month(spark, sf):
    o = obs(spark, sf)
    return A.count_by(
        o.select(F.year("observation_date").alias("obs_year"), F.date_trunc("month", "observation_date").cast("date").alias("obs_ym")),
        ["obs_year", "obs_ym"],
    )


@register("datetime_build")
def q_datetime_build(spark, sf):
    return obs(spark, sf).select("observation_date", "time_observations_started", "observation_datetime").distinct()


@register("safe_dates")
def q_safe_dates(spark, sf):
    _, safe = calendar(spark, sf)
    return CAL.safe_dates_view(safe, SAFE_YEAR)


@register("date_label")
def q_date_label(spark, sf):
    _, safe = calendar(spark, sf)
    d = CAL.safe_dates_view(safe, SAFE_YEAR)
    return d.select("common_name", S.short_date("date_probable_start").alias("label"))


@register("time_of_day")
def q_time_of_day(spark, sf):
    v = fx.visits(spark, sf)
    return v.select("checklist_id", "observation_datetime", S.time_of_day("observation_datetime").alias("time_of_day"))


@register("ratio_rules")
def q_ratio_rules(spark, sf):
    m = cmp.atlas_block_metrics(compare_table(spark, sf))
    return r6(
        m.select(
            "pba3_block",
            S.r_div("species_coded_pba3", "species_coded_pba2").alias("coded_ratio"),
            S.r_div(F.col("species_count_pba2") - F.col("species_count_pba2"), F.lit(0)).alias("zero_over_zero"),
        )
    )


# ---------------------------------------------------------------- 2.9 domain jobs


@register("clean_observations")
def q_clean_observations(spark, sf):
    return r6(obs(spark, sf))


@register("collapse_shared")
def q_collapse_shared(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    p = fx.table(spark, sf, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(
        F.expr("CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'G' || cast(l_orderkey as string) END").alias("group_identifier"),
        F.expr("'S' || cast(l_orderkey as string) || '_' || cast(l_linenumber % 3 as string)").alias(
            "sampling_event_identifier"
        ),
        F.expr("'obsr' || cast((l_suppkey + l_linenumber) % 50 as string)").alias("observer_id"),
        F.col("p_name").alias("common_name"),
        F.expr("CASE WHEN l_returnflag = 'A' THEN 'C4' WHEN l_returnflag = 'N' THEN 'C2' ELSE 'C1' END").alias(
            "breeding_category"
        ),
        F.col("l_quantity").alias("observation_count"),
    )
    return r6(CL.collapse_shared(rows))


@register("calendar_build")
def q_calendar_build(spark, sf):
    """Calendar delivered as CSV text with a header line per file, read back by
    position with the first line of each file skipped, then built."""
    raw = fx.calendar_raw(spark, sf)
    path = scratch(spark, "calendar")
    IO.write_csv_text(raw, path)
    back = IO.read_csv_positional(spark, path, raw.columns, skip=1)
    cal, _ = CAL.calendar_build(back)
    return cal


@register("calendar_view")
def q_calendar_view(spark, sf):
    cal, _ = calendar(spark, sf)
    return CAL.calendar_view(cal, CAL_START, exclude_blank=True, show_priority=False)


@register("sun_times")
def q_sun_times(spark, sf):
    return r6(EF.sun_times(fx.visits(spark, sf)))


@register("season_fanout")
def q_season_fanout(spark, sf):
    return A.count_by(fan(spark, sf), ["season", "observation_month"])


@register("start_time_repair")
def q_start_time_repair(spark, sf):
    return CL.modal_start_times(obs(spark, sf))


@register("day_night_effort")
def q_day_night_effort(spark, sf):
    v = fx.visits(spark, sf)
    return r6(EF.day_night_effort(v, CL.modal_start_times(v), nested=False))


@register("checklist_count")
def q_checklist_count(spark, sf):
    return SE.checklist_count(fan(spark, sf))


@register("species_observed")
def q_species_observed(spark, sf):
    return SE.species_observed(fan(spark, sf))


@register("birders")
def q_birders(spark, sf):
    return SE.birders(fan(spark, sf))


@register("season_coverage")
def q_season_coverage(spark, sf):
    return SE.season_coverage(fan(spark, sf))


@register("nocturnal_coded")
def q_nocturnal_coded(spark, sf):
    return SE.nocturnal_coded(fan(spark, sf), fx.nocturnal_species(spark, sf))


@register("atlas_compare")
def q_atlas_compare(spark, sf):
    return compare_table(spark, sf)


@register("atlas_missing")
def q_atlas_missing(spark, sf):
    return cmp.atlas_missing(compare_table(spark, sf))


@register("atlas_block_metrics")
def q_atlas_block_metrics(spark, sf):
    return r6(cmp.atlas_block_metrics(compare_table(spark, sf)))


@register("expected_species")
def q_expected_species(spark, sf):
    return r6(EX.expected_species(obs(spark, sf)))


@register("eb_moments")
def q_eb_moments(spark, sf):
    return r6(EX.beta_moments(EX.expected_species(obs(spark, sf))))


@register("eb_shrink")
def q_eb_shrink(spark, sf):
    return r6(EX.weighted_rate(EX.eb_shrink_moments(EX.expected_species(obs(spark, sf)))))


@register("eb_shrink_mle", rows_only=True)
def q_eb_shrink_mle(spark, sf):
    es = EX.expected_species(obs(spark, sf))
    a, b = EX.beta_binomial_mle(es)
    return EX.weighted_rate(EX.eb_shrink(es, a, b))


@register("eb_species")
def q_eb_species(spark, sf):
    """Shrunken rate of each species over all blocks and months (prior fitted on the species' totals)."""
    return r6(EX.eb_shrink_moments(EX.expected_species_total(EX.expected_species(obs(spark, sf)))))


@register("eb_prior_by_month", rows_only=True)
def q_eb_prior_by_month(spark, sf):
    return EX.beta_binomial_priors(EX.expected_species(obs(spark, sf)), "month_num")


@register("eb_rank_fitted")
def q_eb_rank_fitted(spark, sf):
    """Top 20 block × species × month by shrunken rate (moment prior), ties by key."""
    es = EX.eb_shrink_moments(EX.expected_species(obs(spark, sf)))
    top = O.top_k(
        es, 20, [F.col("fitted").desc(), F.col("pba3_block"), F.col("common_name"), F.col("month_num")]
    )
    return r6(top.select("pba3_block", "common_name", "month_num", "observations", "checklist_count", "raw", "fitted"))


@register("expected_species_state")
def q_expected_species_state(spark, sf):
    return EX.expected_species_total(EX.expected_species(obs(spark, sf)))


@register("completion_flags")
def q_completion_flags(spark, sf):
    return RP.completion_flags(summary(spark, sf))


@register("progress_table")
def q_progress_table(spark, sf):
    return r6(RP.progress_table(summary(spark, sf), REPORT_SEASON))


@register("missing_report")
def q_missing_report(spark, sf):
    return _missing_for_block(spark, sf)


def _missing_for_block(spark, sf):
    return cmp.missing_report(cmp.atlas_missing(compare_table(spark, sf)), fx.focal_species(spark, sf), MISSING_BLOCK)


@register("report_effort")
def q_report_effort(spark, sf):
    return r6(RP.report_effort(summary(spark, sf), REPORT_BLOCK, REPORT_SEASON))


@register("report_codes")
def q_report_codes(spark, sf):
    return RP.report_codes(summary(spark, sf), REPORT_BLOCK, REPORT_SEASON)


@register("checklist_density")
def q_checklist_density(spark, sf):
    return r6(RP.checklist_density(obs(spark, sf), REPORT_BLOCK, REPORT_SEASON))


def report_breakdown(spark, sf):
    o = obs(spark, sf)
    one = SE.season_fanout(o, REPORT_SEASON).where(F.col("pba3_block") == REPORT_BLOCK)
    return EF.nest_effort(EF.effort_by_date(EF.classify_checklists(one, CL.modal_start_times(o))))


@register("effort_over_time")
def q_effort_over_time(spark, sf):
    return r6(EF.effort_over_time(report_breakdown(spark, sf)))


@register("effort_over_time_known")
def q_effort_over_time_known(spark, sf):
    return r6(EF.effort_over_time(report_breakdown(spark, sf), strict=False))


@register("effort_audit")
def q_effort_audit(spark, sf):
    return r6(EF.effort_audit(obs(spark, sf)))


@register("effort_audit_means")
def q_effort_audit_means(spark, sf):
    return r6(EF.effort_audit_means(EF.effort_audit(obs(spark, sf))))


@register("effort_audit_changed")
def q_effort_audit_changed(spark, sf):
    return r6(EF.effort_audit_changed(EF.effort_audit(obs(spark, sf))))


@register("focal_match")
def q_focal_match(spark, sf):
    return RP.focal_match(fx.focal_species(spark, sf), obs(spark, sf))


@register("map_values")
def q_map_values(spark, sf):
    return r6(RP.map_values(summary(spark, sf), REPORT_SEASON, "duration_hours_diurnal"))


# ---------------------------------------------------------------- 2.10 spatial


@register("convex_hull")
def q_convex_hull(spark, sf):
    """A row per vertex; the area, from the ring in its order, shows that the order is right."""
    h = SP.hull_and_point(obs(spark, sf), "pba3_block")
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    area = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)
    h = h.withColumns({"area": area, "vertices": F.array_distinct("ring")})
    return r6(h.select("pba3_block", "n_points", F.size("vertices").cast("long").alias("n_vertices"), "area", F.inline("vertices")))


@register("interior_point")
def q_interior_point(spark, sf):
    return r6(SP.hull_and_point(obs(spark, sf), "pba3_block").select("pba3_block", "px", "py"))


@register("web_mercator")
def q_web_mercator(spark, sf):
    pts = obs(spark, sf).select("longitude", "latitude").distinct()
    return r6(SP.mercator_points(pts))


@register("bbox_buffer")
def q_bbox_buffer(spark, sf):
    return r6(SP.bbox_buffer(_density_points(spark, sf)))


def _density_points(spark, sf):
    return RP.checklist_density(obs(spark, sf), REPORT_BLOCK, REPORT_SEASON)


#: Old id that is set by hand for a block, as the reference does for one.
PINNED = {"B5": "P-80.0_40.5"}


def crosswalk(spark, sf, overrides=None):
    o = obs(spark, sf)
    return SP.block_crosswalk(o, fx.grid_squares(o), overrides=overrides)


@register("block_crosswalk")
def q_block_crosswalk(spark, sf):
    return crosswalk(spark, sf)


@register("crosswalk_overrides")
def q_crosswalk_overrides(spark, sf):
    return crosswalk(spark, sf, PINNED)


@register("crosswalk_one_to_one")
def q_crosswalk_one_to_one(spark, sf):
    """Ids of either side with more than one partner, counting a missing partner or not."""
    return QC.one_to_one_both_ways(crosswalk(spark, sf), "pba2_block", "pba3_block")


@register("summary_polygons")
def q_summary_polygons(spark, sf):
    return r6(SE.summary_with_polygons(crosswalk(spark, sf), summary(spark, sf)))


# ---------------------------------------------------------------- 2.11 statistics


@register("log_breaks")
def q_log_breaks(spark, sf):
    return ST.log_breaks(_density_points(spark, sf), "checklist_count")


@register("step_bins")
def q_step_bins(spark, sf):
    d = _density_points(spark, sf)
    brks = [r["brk"] for r in ST.log_breaks(d, "checklist_count").collect()]
    return r6(ST.step_bins(d, "checklist_count", brks))


@register("histogram")
def q_histogram(spark, sf):
    return r6(ST.histogram(EX.expected_species(obs(spark, sf)), "observed_pct", 30))


@register("bin_2d")
def q_bin_2d(spark, sf):
    es = EX.expected_species(obs(spark, sf))
    return ST.bin_2d(es, "checklist_count", "observed_pct", 100.0, 0.05)


@register("density")
def q_density(spark, sf):
    es = EX.expected_species(obs(spark, sf))
    return r6(ST.density(es, "observed_pct", group="observation_month"))


# ---------------------------------------------------------------- 2.12 quality


@register("duplicate_keys")
def q_duplicate_keys(spark, sf):
    return A.duplicate_keys(obs(spark, sf), ["checklist_id", "common_name"])


@register("one_to_one")
def q_one_to_one(spark, sf):
    o = obs(spark, sf)
    return SP.one_to_one_violations(o.select("checklist_id", "latitude"), "checklist_id", "latitude")


@register("class_balance")
def q_class_balance(spark, sf):
    v = fx.visits(spark, sf)
    c = EF.classify_checklists(v, CL.modal_start_times(v))
    return A.count_by(c, ["checklist_type"])


@register("class_outliers")
def q_class_outliers(spark, sf):
    """A thousand rows of each class with their sun times as times of day (the rows to look at)."""
    v = fx.visits(spark, sf)
    c = EF.classify_checklists(v, CL.modal_start_times(v))
    return r6(QC.class_outliers(c, 1000, seed=11))


@register("zone_check")
def q_zone_check(spark, sf):
    """Columns whose type changed on the way through Parquet (none), and files that are missing (one that was never written)."""
    path = scratch(spark, "sun")
    sun = EF.sun_times(fx.visits(spark, sf))
    IO.write_parquet(sun, path)
    changed = QC.changed_types(sun, IO.read_parquet(spark, path)).select(F.lit("type").alias("check"), F.col("column").alias("key"))
    missing = QC.missing_sources(spark, [path, f"{path}-nowhere"]).select(F.lit("source").alias("check"), F.substring_index("path", "-", -1).alias("key"))
    return changed.unionByName(missing)


@register("quality_report")
def q_quality_report(spark, sf):
    return QC.quality_report(obs(spark, sf), fx.block_names(spark, sf))


@register("dupe_start_export")
def q_dupe_start_export(spark, sf):
    o = obs(spark, sf)
    cols = ["pba3_block", "checklist_id", "observer_id", "observation_date", "time_observations_started", "observation_datetime"]
    return QC.offending_rows(o, CL.dupe_start_checklists(o), "checklist_id", cols)


@register("multi_valued_keys")
def q_multi_valued_keys(spark, sf):
    return CL.dupe_start_checklists(obs(spark, sf))
