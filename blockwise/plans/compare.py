"""Old-vs-new atlas comparison (C10) and the missing-species report (C15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.semantics import r_div
from blockwise.operators.joins import full_outer_on_keys, join_on, lookup
from blockwise.operators.reshape import pivot_longer
from blockwise.plans.lookups import TAXONOMY_RENAMES, breeding_lookup
from blockwise.plans.season import with_block_names

KEYS = ["pba3_block", "common_name"]


def recode(c: str, mapping: dict[str, str]):
    """``case_when(c == old ~ new, .default = c)`` as one CASE expression."""
    out = None
    for old, new in mapping.items():
        out = (F.when(F.col(c) == old, new) if out is None else out.when(F.col(c) == old, new))
    return F.col(c) if out is None else out.otherwise(F.col(c))


def old_atlas_from_matrix(
    wide: DataFrame,
    id_cols: Sequence[str],
    renames: dict[str, str] = TAXONOMY_RENAMES,
    drop_pattern: str = "N/A",
    keep_first: int | None = None,
) -> DataFrame:
    """Wide old-atlas matrix -> (pba3_block, common_name, pba2 category, pba2 rank).

    Unpivot keeps blank cells as NULL rows (``pivot_longer`` default), species
    columns whose name holds ``drop_pattern`` are dropped, names are moved to
    the new taxonomy and "Observed/Possible" becomes "Observed". Only
    ``distinct``, not max'ed, like the reference (T17). ``keep_first`` keeps
    only the first N columns of the matrix (positional, as delivered).
    """
    if keep_first is not None:
        wide = wide.select(*wide.columns[:keep_first])
    long = pivot_longer(wide, list(id_cols), "common_name", "breeding_category_desc")
    long = long.where(~F.col("common_name").contains(drop_pattern))
    long = long.withColumns(
        {
            "common_name": recode("common_name", renames),
            "breeding_category_desc": recode("breeding_category_desc", {"Observed/Possible": "Observed"}),
        }
    )
    lk = breeding_lookup(wide.sparkSession).select("breeding_category_desc", "breeding_rank")
    return (
        lookup(long, lk, ["breeding_category_desc"])
        .select("pba3_block", "common_name", "breeding_category_desc", "breeding_rank")
        .distinct()
        .withColumnsRenamed(
            {"breeding_category_desc": "pba2_breeding_category_max", "breeding_rank": "pba2_breeding_rank_max"}
        )
    )


def new_atlas_max(obs: DataFrame, strict: bool = False) -> DataFrame:
    """Highest category per (block, species) in the new atlas; ties kept.

    One aggregate: a (block, species) has at most a handful of distinct (rank,
    category) pairs, which are kept as a set; the pairs of the highest rank
    become rows again. ``strict`` drops keys with an unknown rank (T4).
    """
    pairs = F.collect_set(F.struct(F.col("breeding_rank").alias("r"), F.col("breeding_category_desc").alias("c")))
    per = obs.groupBy(*KEYS).agg(pairs.alias("p"), F.max("breeding_rank").alias("m"), F.count_if(F.col("breeding_rank").isNull()).alias("unknown"))
    if strict:
        per = per.where("unknown = 0")
    top = F.filter("p", lambda x: x["r"] == F.col("m"))
    named = {"c": "pba3_breeding_category_max", "r": "pba3_breeding_rank_max"}
    return per.select(*KEYS, F.explode(top).alias("t")).select(*KEYS, *[F.col(f"t.{k}").alias(v) for k, v in named.items()])


def atlas_compare(old: DataFrame, new: DataFrame, names: DataFrame) -> DataFrame:
    """Every (block, species) in either atlas, both ranks (missing -> Not Observed / 0), names."""
    both = full_outer_on_keys(old, new, KEYS).na.fill(
        {
            "pba2_breeding_category_max": "Not Observed",
            "pba2_breeding_rank_max": 0,
            "pba3_breeding_category_max": "Not Observed",
            "pba3_breeding_rank_max": 0,
        }
    )
    out = with_block_names(both, names)
    return out.select(
        "pba3_block",
        "block_name",
        "block_region",
        "common_name",
        "pba2_breeding_category_max",
        "pba2_breeding_rank_max",
        "pba3_breeding_category_max",
        "pba3_breeding_rank_max",
        "block_county",
    )


def atlas_missing(compare: DataFrame) -> DataFrame:
    """Species whose old-atlas category is higher than the new one."""
    return compare.where(F.col("pba2_breeding_rank_max") > F.col("pba3_breeding_rank_max"))


def atlas_block_metrics(compare: DataFrame) -> DataFrame:
    """Per block: species / coded counts in each atlas, two shares and the coded ratio.

    ``pct_missing_pba2_confirmations`` divides by all species rows of the
    block (T16); the ratio uses R's division rule (T6).
    """
    r2, r3 = F.col("pba2_breeding_rank_max"), F.col("pba3_breeding_rank_max")
    out = compare.groupBy("pba3_block").agg(
        F.count_if(r2 > 0).alias("species_count_pba2"),
        F.count_if(r2 > 1).alias("species_coded_pba2"),
        F.count_if(r3 > 0).alias("species_count_pba3"),
        F.count_if(r3 > 1).alias("species_coded_pba3"),
        F.avg(((r2 == 4) & (r3 < 4)).cast("double")).alias("pct_missing_pba2_confirmations"),
        F.avg((r3 >= r2).cast("double")).alias("pct_coded_atlas_comparison"),
    )
    return out.withColumn(
        "pba3_pba2_coded_count_compare_pct", r_div("species_coded_pba3", "species_coded_pba2")
    )


def missing_report(missing: DataFrame, focal: DataFrame, block_id: str) -> DataFrame:
    """Missing-in-new-atlas species of one block, largest rank drop first, focal flag."""
    one = missing.where(F.col("pba3_block") == block_id).withColumn(
        "atlas_diff", F.col("pba2_breeding_rank_max") - F.col("pba3_breeding_rank_max")
    )
    out = join_on(one, focal.select("common_name", "is_focal"), ["common_name"], "left", null_safe=True)
    out = out.withColumn("is_focal", F.coalesce(F.col("is_focal"), F.lit(False)))
    ranks = [F.col(c).desc_nulls_last() for c in ("atlas_diff", "pba2_breeding_rank_max")]
    return out.orderBy(*ranks, F.col("common_name").asc_nulls_last()).select(
        "pba3_block",
        "block_name",
        "common_name",
        "is_focal",
        "pba3_breeding_category_max",
        "pba2_breeding_category_max",
    )
