"""Adapter views that give the driver's test tables the roles of survey data.

``lineitem ⋈ orders ⋈ part`` plays the checklist extract, ``events`` plays
timed visits, ``supplier → nation → region`` the block name lookup, ``part``
the species lists, ``orders`` the breeding calendar. The same definitions are
written in DuckDB SQL in ``blockwise.oracle`` (the correctness oracle).
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.functions.semantics import MONTH_ABB

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Fixed values of the adapter: flag pair -> raw breeding category text.
CATEGORY_SQL = """CASE
  WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN ' C4'
  WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'C3 '
  WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'C2'
  WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'C1'
  WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '  C1 '
  ELSE NULL END"""


JOINED = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_tax l_returnflag l_linestatus "
    "o_orderkey o_custkey o_orderdate o_orderpriority o_orderstatus p_name"
).split()

_TABLES: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one test table; the DataFrame is reused per session and path
    (its schema is read once, and equal subtrees let Spark reuse exchanges)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    known = _TABLES.setdefault(spark, {})
    if path not in known:
        known[path] = spark.read.parquet(path)
    return known[path]


def joined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem ⋈ orders ⋈ part`` with the columns that observations and the old atlas are made of."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(*JOINED)


def raw_observations(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Checklist-extract-shaped rows (one species on one checklist per row); ``rows``: ``joined_rows`` that are stored already."""
    j = joined_rows(spark, sf_dir) if rows is None else rows
    e = F.expr
    return j.select(
        e("'B' || cast(l_suppkey % 20 as string)").alias("atlas_block"),
        e("'S' || cast(l_orderkey as string)").alias("checklist_id"),
        e("cast(o_custkey as string) || ',' || cast(o_custkey % 7 as string)").alias("observer_id"),
        F.col("p_name").alias("common_name"),
        e(f"CASE WHEN ({CATEGORY_SQL}) IS NULL THEN NULL ELSE '  ' || l_returnflag || '   ' || l_linestatus END").alias(
            "breeding_code"
        ),
        e(CATEGORY_SQL).alias("breeding_category"),
        e(
            "CASE WHEN l_linenumber = 1 THEN 'X' WHEN l_linenumber = 7 THEN NULL "
            "ELSE cast(cast(l_quantity as bigint) as string) END"
        ).alias("observation_count"),
        e("cast(o_orderdate as date)").alias("observation_date"),
        e(
            "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE lpad(cast((o_orderkey * 7) % 24 as string), 2, '0') || ':' || "
            "(CASE WHEN o_orderkey % 5 = 0 AND l_linenumber = 2 THEN '30' ELSE '00' END) || ':00' END"
        ).alias("time_observations_started"),
        e("cast(o_custkey % 50 - 800 as double) / 10").alias("longitude"),
        e("cast(l_suppkey % 20 * 2 + l_partkey % 7 + 800 as double) / 20").alias("latitude"),
        F.col("l_quantity").alias("duration_minutes"),
        e("l_tax * 10").alias("effort_distance_km"),
        e("CASE WHEN o_orderpriority = '5-LOW' THEN 'Other' ELSE 'Atlas' END").alias("project_names"),
        e(
            "CASE o_orderstatus WHEN 'F' THEN 'Traveling' WHEN 'O' THEN 'Stationary' ELSE 'Incidental' END"
        ).alias("protocol_name"),
    )


def observations(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Processed observations: cleaned (C1) and joined to the breeding-rank lookup."""
    from blockwise.plans.clean import clean_observations, with_breeding_rank

    return with_breeding_rank(clean_observations(raw_observations(spark, sf_dir, rows)))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed visits from ``events`` (January 2024: both day and night visits occur)."""
    ev = table(spark, sf_dir, "events")
    e = F.expr
    return ev.select(
        e("'B' || cast(user_id % 20 as string)").alias("pba3_block"),
        e("'E' || cast(event_id % 500 as string)").alias("checklist_id"),
        e("cast(user_id as string) || ',' || cast(user_id % 3 as string)").alias("observer_id"),
        F.col("event_type").alias("common_name"),
        F.col("ts").alias("observation_datetime"),
        e("cast(ts as date)").alias("observation_date"),
        e("cast(user_id % 50 - 800 as double) / 10").alias("longitude"),
        e("cast(user_id % 20 + 400 as double) / 10").alias("latitude"),
        F.col("value").alias("duration_minutes"),
    )


def block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block name lookup: (pba3_block, block_name, block_region, block_county), one row per block."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.expr("'B' || cast(s_suppkey % 20 as string)").alias("pba3_block")).agg(
        F.min("s_name").alias("block_name"), F.min("r_name").alias("block_region"), F.min("n_name").alias("block_county")
    )


def nocturnal_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_size") >= 50).select(F.col("p_name").alias("common_name")).distinct()


def focal_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_size") <= 1)
        .select(F.col("p_name").alias("common_name"))
        .distinct()
        .withColumn("is_focal", F.lit(True))
    )


# Fixed value: rank -> category text as written in the old-atlas matrix.
OLD_ATLAS_TEXT = {1: "Observed/Possible", 2: "Possible", 3: "Probable", 4: "Confirmed"}


def old_atlas_long(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Old-atlas (block, species, category text) from 1995-1997 rows on the old 25-block grid.

    Plays the block × species matrix of the previous atlas; its block grid
    differs from the new one, so both sides have keys the other lacks.
    """
    j = (joined_rows(spark, sf_dir) if rows is None else rows).where(F.year("o_orderdate") < 1998)
    rank = F.expr(
        "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 4 WHEN l_returnflag = 'A' THEN 3 "
        "WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 2 ELSE 1 END"
    )
    m = j.groupBy(F.expr("'B' || cast(l_suppkey % 25 as string)").alias("pba3_block"), F.col("p_name").alias("species")).agg(
        F.max(rank).alias("r")
    )
    text = F.element_at(F.create_map(*[x for k, v in OLD_ATLAS_TEXT.items() for x in (F.lit(k), F.lit(v))]), F.col("r"))
    return m.select("pba3_block", "species", text.alias("category"))


def old_atlas_wide(spark: SparkSession, sf_dir: str, species: list[str], rows: DataFrame | None = None) -> DataFrame:
    """The old atlas as a wide matrix (one column per species), as delivered."""
    long = old_atlas_long(spark, sf_dir, rows)
    return long.groupBy("pba3_block").pivot("species", species).agg(F.first("category")).withColumn(
        "block_name", F.concat(F.lit("Old "), F.col("pba3_block"))
    )


def calendar_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breeding-calendar-shaped wide table from ``orders``: 6 leading columns then 48 week codes."""
    o = table(spark, sf_dir, "orders")
    wk = F.least(F.ceil(F.dayofmonth("o_orderdate") / 7.75), F.lit(4)).cast("int")
    name = F.when(F.col("o_orderpriority").startswith("1"), F.concat("o_orderpriority", F.lit("*"))).otherwise(
        F.col("o_orderpriority")
    )
    week_label = F.concat(F.date_format("o_orderdate", "MMM"), F.lit(" "), wk.cast("string"))
    counts = o.groupBy(name.alias("common_name"), week_label.alias("week")).count()
    code = F.substring(F.lit("BEMN"), (F.col("count") % 5).cast("int"), 1)
    weeks = [f"{m} {i}" for m in MONTH_ABB for i in range(1, 5)]
    wide = counts.withColumn("code", F.when(F.col("count") % 5 > 0, code)).groupBy("common_name").pivot("week", weeks).agg(
        F.first("code")
    )
    dates = o.groupBy(name.alias("common_name")).agg(
        F.substring(F.min("o_orderpriority"), 1, 1).cast("int").alias("taxonomic_order"),
        F.date_format(F.date_add(F.min("o_orderdate").cast("date"), 30), "d-MMM").alias("safe_date_probable_start"),
        F.date_format(F.min("o_orderdate"), "d-MMM").alias("safe_date_possible_start"),
        F.date_format(F.max("o_orderdate"), "d-MMM").alias("safe_date_possible_end"),
        F.date_format(F.date_sub(F.max("o_orderdate").cast("date"), 30), "d-MMM").alias("safe_date_probable_end"),
    )
    lead = [
        "taxonomic_order",
        "common_name",
        "safe_date_probable_start",
        "safe_date_possible_start",
        "safe_date_possible_end",
        "safe_date_probable_end",
    ]
    return dates.join(wide, "common_name").select(*lead, *weeks)


def grid_squares(obs: DataFrame, size: float = 0.1) -> DataFrame:
    """Polygons: a ``size``-degree square with its lower-left corner at each observed point."""
    pts = obs.select("longitude", "latitude").distinct()
    x0, y0 = F.col("longitude"), F.col("latitude")
    x1, y1 = x0 + size, y0 + size
    ring = F.array(
        F.struct(x0.alias("x"), y0.alias("y")),
        F.struct(x1.alias("x"), y0.alias("y")),
        F.struct(x1.alias("x"), y1.alias("y")),
        F.struct(x0.alias("x"), y1.alias("y")),
        F.struct(x0.alias("x"), y0.alias("y")),
    )
    pid = F.concat(F.lit("P"), F.col("longitude").cast("string"), F.lit("_"), F.col("latitude").cast("string"))
    return pts.select(pid.alias("pba2_block"), ring.alias("ring"))


def slanted_polygons(obs: DataFrame, radius: float = 0.2) -> DataFrame:
    """Polygons with slanted edges that run through other points, and one without points.

    A diamond of ``radius`` degrees around the southernmost point of each
    longitude, and an empty ring.
    """
    x, y = F.col("longitude"), F.col("latitude")
    south = obs.where(x.isNotNull()).groupBy("longitude").agg(F.min("latitude").alias("latitude"))
    corner = lambda dx, dy: F.struct((x + dx * radius).alias("x"), (y + dy * radius).alias("y"))
    ring = F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0))
    diamonds = south.select(F.concat(F.lit("D"), x.cast("string")).alias("pba2_block"), ring.alias("ring"))
    empty = diamonds.sparkSession.createDataFrame([("EMPTY", [])], diamonds.schema)
    return diamonds.unionByName(empty)
