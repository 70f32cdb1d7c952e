"""Steps that must not grow with more than their input: ring tests, start times, season rows, rates of a sample."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from blockwise import registry
from blockwise.functions import semantics as S
from blockwise.plans import season as SE
from blockwise.plans.spatial import covers_join
from blockwise.session import stored_tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_covers_join_tests_a_shared_place_once(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    polys = spark.createDataFrame([("a", square), ("far", [(x + 9, y) for x, y in square])], "pid string, ring array<struct<x:double,y:double>>")
    pts = spark.range(300).select("id", F.lit(0.5).alias("px"), F.lit(1.0).alias("py")).unionByName(spark.createDataFrame([(300, None, 0.5)], "id long, px double, py double"))
    with stored_tables(spark) as stored:
        rows = covers_join(polys, pts).drop("ring").collect()
        met = [t for t in map(spark.read.parquet, stored) if {"pid", "__px"} <= set(t.columns)]
        assert [t.count() for t in met] == [1]
    assert sorted((r.pid, -1 if r.id is None else r.id) for r in rows) == [("a", i) for i in range(300)] + [("far", -1)]


def test_filter_on_a_start_names_the_time_once(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 10), "02:30")], "d date, reported string")
    kept = df.select(S.build_local_datetime("d", "reported", "America/New_York").alias("ts")).where("ts is not null")
    assert plan(kept.select(F.lit(1))).count("trim(reported") <= 2


@pytest.mark.parametrize(
    ("zone", "day"),
    [("America/New_York", "2024-03-10"), ("America/New_York", "2024-11-03"), ("Pacific/Apia", "2011-12-30"), ("America/Toronto", "1919-03-30"), ("America/Sao_Paulo", "2017-10-15"), ("Australia/Lord_Howe", "2024-10-06")],
)
def test_gap_as_by_conversion(spark, zone, day):
    start = F.lit(day).cast("timestamp_ntz")
    ts = spark.range(-60, 180).select((start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int") * 20)).alias("ts"))
    ts = ts.withColumns({"d": F.to_date("ts"), "t": F.date_format("ts", "HH:mm:ss")})
    want = F.when(S.from_utc(S.to_utc("ts", zone), zone) == F.col("ts"), F.col("ts"))
    rows = ts.select("ts", want.alias("want"), S.null_dst_gap("ts", zone).alias("a"), S.build_local_datetime("d", "t", zone).alias("b")).collect()
    assert [(r.ts, r.a, r.b) for r in rows] == [(r.ts, r.want, r.want) for r in rows]


def test_utc_clock_keeps_microseconds(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("select timestamp_ntz'2024-03-10 02:30:01.234567' as ts").select(F.unix_micros(S.utc_clock("ts")).alias("u")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["u"] == 1710037801234567


def test_season_rows_stay_in_generated_code(spark):
    schema = "pba3_block string, checklist_id string, observation_month_num int, observation_datetime timestamp_ntz, duration_minutes double, effort_distance_km double"
    cg = spark.createDataFrame([("B", "c", 6, None, 1.0, 2.0), ("B", "c", 12, None, 3.0, None)], schema)
    rows = SE.checklist_rows(cg)
    assert "lambda" not in plan(rows)
    assert sorted((r.season, r.d, r.k) for r in rows.collect()) == [("All seasons", 3.0, 2.0), ("Breeding", 1.0, 2.0), ("Winter", 3.0, None)]


def test_weighted_sample_stores_the_rates(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(registry, "materialize", lambda df, tag: kept.append(tag) or df)
    monkeypatch.setattr(registry, "obs", lambda spark, sf: None)
    rates = spark.createDataFrame([("b", str(i), 6, i % 7, 9) for i in range(20)], "pba3_block string, common_name string, month_num int, observations long, checklist_count long")
    monkeypatch.setattr(registry.EX, "expected_species", lambda o: rates)
    assert registry.q_sample_weighted(spark, "").count() == 2
    assert kept == ["expected-species"]


def test_summary_joins_its_tables_once(spark, monkeypatch):
    """Both grains and the old atlas read one stored join."""
    read, table = [], registry.fx.table
    monkeypatch.setattr(registry.fx, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    assert registry.summary(spark, "/root/testdata/sf0.001").count() > 0
    assert read.count("lineitem") == 1 and read.count("orders") == 1
