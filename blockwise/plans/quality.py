"""Data-quality checks (Q1–Q8). Each returns rows; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.functions.semantics import from_utc, n_distinct, time_of_day
from blockwise.functions.sun import with_sun_events_utc
from blockwise.operators.aggregate import count_by, duplicate_keys, multi_valued_keys
from blockwise.operators.joins import anti_join, join_on, union_rows
from blockwise.operators.sampling import sample_per_group
from blockwise.plans.spatial import one_to_one_violations
from blockwise.session import LOCAL_TZ


def keys_missing_both_ways(a: DataFrame, b: DataFrame, key: str, a_name: str = "a", b_name: str = "b") -> DataFrame:
    """Key values in ``a`` not in ``b`` and in ``b`` not in ``a``, tagged with the side."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return union_rows(
        anti_join(ka, kb, [key]).withColumn("missing_from", F.lit(b_name)),
        anti_join(kb, ka, [key]).withColumn("missing_from", F.lit(a_name)),
    )


def one_to_one_both_ways(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Ids of either side with more than one partner: (side, id, partners, partners_with_null).

    ``partners`` counts real partners, ``partners_with_null`` a missing partner
    as one more; rows with ``partners > 1`` break the relation, rows with only
    ``partners_with_null > 1`` break it if missing partners count. The pairs
    are made distinct once, then each side is one aggregate; no rows is a pass.
    """
    ids = [F.struct(F.lit(s).alias("side"), F.col(s).cast("string").alias("id"), F.col(o).isNotNull().alias("real")) for s, o in ((left, right), (right, left))]
    sides = pairs.select(left, right).distinct().select(F.inline(F.array(*ids))).where("id is not null")
    counted = sides.groupBy("side", "id").agg(F.count_if("real").alias("partners"), F.count(F.lit(1)).alias("partners_with_null"))
    return counted.where("partners_with_null > 1")


def class_outliers(classified: DataFrame, n: int, seed: int = 42, tz: str = LOCAL_TZ) -> DataFrame:
    """``n`` random rows of each class with date, start and sun times as times of day, for a look at odd ones.

    The sun times are worked out for the drawn rows only.
    """
    keys = ["pba3_block", "checklist_id", "longitude", "latitude"]
    drawn = sample_per_group(classified, ["checklist_type"], n, keys, seed)
    sun = with_sun_events_utc(drawn, "longitude", "latitude", F.to_date("observation_datetime"), "__r", "__s")
    return sun.select(
        "checklist_type",
        *keys,
        F.to_date("observation_datetime").alias("observation_date"),
        time_of_day("observation_datetime").alias("start"),
        time_of_day(from_utc("__r", tz)).alias("sunrise"),
        time_of_day(from_utc("__s", tz)).alias("sunset"),
    )


def changed_types(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before, after) of columns whose type differs, time zone handling included: ``timestamp`` is an instant
    shown in the session's zone, ``timestamp_ntz`` a wall-clock time that no zone moves. No rows is a pass."""
    a, b = dict(before.dtypes), dict(after.dtypes)
    rows = [(c, a.get(c), b.get(c)) for c in [*a, *[c for c in b if c not in a]] if a.get(c) != b.get(c)]
    return before.sparkSession.createDataFrame(rows, "column string, before string, after string")


def missing_sources(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The paths (or glob patterns) that Spark cannot read; no rows is a pass."""
    missing = []
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append((p,))
    return spark.createDataFrame(missing, "path string")


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def quality_report(obs: DataFrame, names: DataFrame) -> DataFrame:
    """All observation checks as one table (check, key, n); an empty table is a pass.

    * ``duplicate_checklist_species``: a species twice on one checklist
    * ``multi_start_checklist``: a checklist with more than one start time
    * ``multi_location_checklist``: a checklist at more than one place (longitude and latitude)
    * ``block_without_name`` / ``name_without_observations``: lookup gaps both ways
    """
    key_n = ["check", "key", "n"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in ("checklist_id", "common_name")]
    dup = duplicate_keys(obs, ["checklist_id", "common_name"]).select(
        F.lit("duplicate_checklist_species").alias("check"), F.concat_ws("|", *text).alias("key"), "n"
    )
    # One aggregate serves both checklist checks.
    per_checklist = obs.groupBy("checklist_id").agg(
        n_distinct("observation_datetime").alias("starts"),
        F.count_distinct(F.struct(F.coalesce("longitude", F.lit(float("nan"))), F.coalesce("latitude", F.lit(float("nan"))))).alias("places"),
    )
    checks = F.array(
        F.struct(F.lit("multi_start_checklist").alias("check"), F.col("starts").cast("long").alias("n")),
        F.struct(F.lit("multi_location_checklist").alias("check"), F.col("places").cast("long").alias("n")),
    )
    of_checklist = per_checklist.select("checklist_id", F.explode(checks).alias("c")).where("c.n > 1")
    of_checklist = of_checklist.select("c.check", F.col("checklist_id").alias("key"), "c.n")
    # One full join of blocks and names serves both lookup checks.
    sides = join_on(
        count_by(obs, ["pba3_block"]).withColumn("seen", F.lit(True)),
        names.select("pba3_block").distinct().withColumn("named", F.lit(True)),
        ["pba3_block"], "full", null_safe=True,
    )
    gaps = sides.where("(seen is null or named is null) and pba3_block is not null").select(
        F.when(F.col("named").isNull(), "block_without_name").otherwise("name_without_observations").alias("check"),
        F.col("pba3_block").alias("key"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
    return union_rows(dup, of_checklist, gaps).select(*key_n)


def offending_rows(obs: DataFrame, bad_keys: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of the offending keys, every column as text (for export)."""
    from blockwise.operators.joins import semi_join

    rows = semi_join(obs.select(*cols).distinct(), bad_keys, [key])
    return rows.select([F.col(c).cast("string").alias(c) for c in cols])


__all__ = [
    "quality_report",
    "offending_rows",
    "keys_missing_both_ways",
    "duplicate_keys",
    "one_to_one_violations",
    "multi_valued_keys",
    "one_to_one_both_ways",
    "class_outliers",
    "changed_types",
    "missing_sources",
    "date_range",
]
