"""Micro-table tests for the NULL / NaN / tie rules."""

import datetime as dt
import math

from pyspark.sql import functions as F

from blockwise.functions import semantics as S
from blockwise.operators.aggregate import modal_value, rows_at_group_max
from blockwise.operators.joins import join_on


def test_n_distinct_counts_null_once(spark):  # T2
    df = spark.createDataFrame([("a",), (None,), ("b",), (None,), ("a",)], "x string")
    assert df.agg(S.n_distinct("x").alias("n")).first()["n"] == 3


def test_r_div_zero_rules(spark):  # T6
    df = spark.createDataFrame([(0, 0), (3, 0), (-3, 0), (1, 4), (None, 2)], "a int, b int")
    out = [r["q"] for r in df.select(S.r_div("a", "b").alias("q")).collect()]
    assert out[0] is None and out[1] == math.inf and out[2] == -math.inf and out[3] == 0.25 and out[4] is None


def test_infinite_ratio_passes_threshold_nan_does_not(spark):  # T6
    df = spark.createDataFrame([(0, 0), (5, 0)], "a int, b int").select((S.r_div("a", "b") >= 0.8).alias("f"))
    assert [r["f"] for r in df.collect()] == [None, True]


def test_strict_max_and_sum(spark):  # T4, T5
    df = spark.createDataFrame([("g", 1), ("g", None), ("h", 2)], "k string, v int")
    got = {r["k"]: (r["m"], r["s"]) for r in df.groupBy("k").agg(S.strict_max("v").alias("m"), S.strict_sum("v").alias("s")).collect()}
    assert got == {"g": (None, None), "h": (2, 2)}


def test_sum0_all_null_is_zero(spark):  # T3
    df = spark.createDataFrame([("g", None)], "k string, v double")
    assert df.groupBy("k").agg(S.sum0("v").alias("s")).first()["s"] == 0.0


def test_bround_half_even(spark):  # T7
    df = spark.createDataFrame([(2.5,), (3.5,), (0.125,)], "x double").select(F.bround("x", 0).alias("a"))
    assert [r["a"] for r in df.collect()] == [2.0, 4.0, 0.0]


def test_nulls_sort_last_both_ways(spark):  # T8
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r["x"] for r in df.orderBy(S.asc_last("x")).collect()] == [1, 2, None]
    assert [r["x"] for r in df.orderBy(S.desc_last("x")).collect()] == [2, 1, None]


def test_datetime_build_null_and_dst_gap(spark):  # T9, T10
    df = spark.createDataFrame(
        [(dt.date(2024, 3, 10), "02:30:00"), (dt.date(2024, 3, 10), None), (dt.date(2024, 6, 1), "07:15"), (dt.date(2024, 6, 1), "25:00:00")],
        "d date, t string",
    )
    out = [r["ts"] for r in df.select(S.build_local_datetime("d", "t", "America/New_York").alias("ts")).collect()]
    assert out == [None, None, dt.datetime(2024, 6, 1, 7, 15), None]


def test_mode_ties_smallest_and_nulls_ignored(spark):  # T11
    df = spark.createDataFrame([("c", 3), ("c", 1), ("c", 3), ("c", 1), ("c", None), ("c", None), ("c", None), ("d", None)], "k string, v int")
    got = {r["k"]: r["m"] for r in modal_value(df, ["k"], "v", "m").collect()}
    assert got == {"c": 1}


def test_remove_first_only(spark):  # T18
    df = spark.createDataFrame([("a*b*c",), ("x\ny*",)], "s string")
    assert [r["o"] for r in df.select(S.remove_first("s", r"\*").alias("o")).collect()] == ["ab*c", "x\ny"]


def test_null_safe_join_matches_null(spark):  # T1
    a = spark.createDataFrame([(None, 1), ("b", 2)], "k string, x int")
    b = spark.createDataFrame([(None, 10), ("b", 20)], "k string, y int")
    assert {(r["k"], r["y"]) for r in join_on(a, b, ["k"], "left", null_safe=True).collect()} == {(None, 10), ("b", 20)}
    assert {r["y"] for r in join_on(a, b, ["k"], "left").collect()} == {None, 20}


def test_rows_at_group_max_keeps_ties_and_strict(spark):  # T4 / A11
    df = spark.createDataFrame([("g", 2, "a"), ("g", 2, "b"), ("g", 1, "c"), ("h", None, "d"), ("h", 1, "e")], "k string, r int, t string")
    assert sorted(r["t"] for r in rows_at_group_max(df, ["k"], "r").collect()) == ["a", "b", "e"]
    assert sorted(r["t"] for r in rows_at_group_max(df, ["k"], "r", strict=True).collect()) == ["a", "b"]


def test_parse_number(spark):  # F10
    df = spark.createDataFrame([("X",), ("1,200",), ("abc",), (None,), ("12 birds",)], "s string")
    assert [r["n"] for r in df.select(S.parse_number("s").alias("n")).collect()] == [1.0, 1200.0, None, None, 12.0]


def test_squish(spark):  # F1
    df = spark.createDataFrame([("  a \t b\n\nc  ",)], "s string")
    assert df.select(S.squish("s").alias("o")).first()["o"] == "a b c"


def test_safe_date_formats(spark):  # F14
    df = spark.createDataFrame([("15-Apr",), ("3-7",), ("29-Feb",), ("junk",)], "s string")
    out = [r["d"] for r in df.select(S.safe_date("s", 2025).alias("d")).collect()]
    assert out == [dt.date(2025, 4, 15), dt.date(2025, 7, 3), None, None]


def test_kleene_flags(spark):  # F18
    df = spark.createDataFrame([(None, True), (None, False), (True, True)], "a boolean, b boolean")
    assert [r["x"] for r in df.select((F.col("a") & F.col("b")).alias("x")).collect()] == [None, False, True]


def test_month_label_null_date_is_null(spark):  # element_at with a NULL index must not pick the last month
    df = spark.createDataFrame([(None,), (dt.date(2024, 3, 5),)], "d date")
    assert [r["m"] for r in df.select(S.month_label("d").alias("m")).collect()] == [None, "Mar"]


def test_natural_join_uses_shared_names(spark):  # J3
    from blockwise.operators.joins import natural_join

    a = spark.createDataFrame([("b1", "c1", 1), ("b1", "c2", 2)], "pba3_block string, checklist_id string, x int")
    b = spark.createDataFrame([("b1", "c1", 10)], "pba3_block string, checklist_id string, y int")
    out = natural_join(a, b, "left").orderBy("checklist_id").collect()
    assert [(r["checklist_id"], r["y"]) for r in out] == [("c1", 10), ("c2", None)]
    assert natural_join(a, b).columns == ["pba3_block", "checklist_id", "x", "y"]
