"""More rule and property tests: time-zone independence, key merging, flags, calendar, stats."""

import datetime as dt
import math

from pyspark.sql import functions as F

from blockwise.operators.joins import combine_by_key, join_chain
from blockwise.plans import calendar as CAL
from blockwise.plans.effort import classify_checklists, sun_times
from blockwise.plans.reports import completion_flags
from blockwise.plans.stats import density, histogram, log_breaks

SF001 = "/root/testdata/sf0.001"


def test_results_do_not_depend_on_session_time_zone(spark):
    rows = [(-79.99, 40.44, dt.datetime(2024, 3, 10, 7, 30)), (-75.1, 39.9, dt.datetime(2024, 11, 3, 1, 30))]
    df = spark.createDataFrame(rows, "longitude double, latitude double, observation_datetime timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        a = sorted(sun_times(df).collect())
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        b = sorted(sun_times(df).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert a == b


def test_combine_by_key_equals_null_safe_join_chain(spark):
    a = spark.createDataFrame([("s", None, 1), ("s", "b1", 2), ("w", "b1", 3)], "season string, pba3_block string, x int")
    b = spark.createDataFrame([("s", None, 10.0), ("w", "b1", 30.0)], "season string, pba3_block string, y double")
    c = spark.createDataFrame([("s", "b1", "q")], "season string, pba3_block string, z string")
    keys = ["season", "pba3_block"]
    got = {tuple(r) for r in combine_by_key([a, b, c], keys).select("season", "pba3_block", "x", "y", "z").collect()}
    want = {tuple(r) for r in join_chain([a, b, c], keys).select("season", "pba3_block", "x", "y", "z").collect()}
    assert got == want and len(got) == 3


def test_completion_flags_division_rules(spark):
    cols = (
        "pba3_block string, block_name string, block_county string, season string, Observed long, Possible long, "
        "Probable long, Confirmed long, pba3_pba2_coded_count_compare_pct double, duration_hours_total double, "
        "breeding_season_months_covered long, nocturnal_species_coded long, duration_hours_nocturnal double"
    )
    rows = [
        ("A", "a", "c", "All seasons", 5, None, None, None, float("inf"), 30.0, 4, 0, 3.0),
        ("B", "b", "c", "All seasons", 1, 10, 30, 40, None, 10.0, None, 3, 0.0),
        (None, "n", "c", "All seasons", 1, 1, 1, 1, 1.0, 1.0, 1, 1, 1.0),
    ]
    out = {r["pba3_block"]: r for r in completion_flags(spark.createDataFrame(rows, cols)).collect()}
    assert set(out) == {"A", "B"}
    a, b = out["A"], out["B"]
    assert a["flag_confirmed_pct"] is None and a["flag_possible_pct"] is None  # 0/0 -> NA
    assert a["flag_coded_atlas_comparison"] is True  # Inf >= .8
    assert a["flag_nocturnal_coverage"] is True and a["all_criteria_complete"] is False  # coded < 70
    assert b["flag_coded_atlas_comparison"] is None and b["flag_breeeding_season_coverage"] is None
    assert b["flag_nocturnal_coverage"] is True and b["all_criteria_complete"] is False


def test_calendar_view_first_shown_week(spark):
    weeks = {w: "" for w in CAL.WEEKS}
    r1 = dict(weeks, **{"Jun 1": "B"})
    r2 = dict(weeks, **{"Jan 1": "N"})
    schema = "taxonomic_order int, common_name string, priority_species boolean, " + ", ".join(f"`{w}` string" for w in CAL.WEEKS)
    cal = spark.createDataFrame(
        [(1, "sp1", True, *[r1[w] for w in CAL.WEEKS]), (2, "sp2", False, *[r2[w] for w in CAL.WEEKS])], schema
    )
    june = CAL.calendar_view(cal, "Jun", exclude_blank=True, show_priority=False)
    assert [r["common_name"] for r in june.collect()] == ["sp1"] and june.columns[1] == "Jun 1"
    jan = CAL.calendar_view(cal, None, exclude_blank=True, show_priority=True)
    assert [r["common_name"] for r in jan.collect()] == ["sp2"] and jan.columns[:3] == ["common_name", "priority_species", "Jan 1"]


def test_log_breaks_like_r(spark):
    df = spark.createDataFrame([(1,), (1000,)], "n long")
    got = sorted(r["brk"] for r in log_breaks(df, "n", 10).collect())
    want = sorted({float(round(math.exp(math.log(1) + i * (math.log(1000) - math.log(1)) / 9))) for i in range(10)})
    assert got == want


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = {r["bin"]: r["n"] for r in histogram(df, "x", 5).collect()}
    assert sum(h.values()) == 11 and h[4] == 3


def test_density_integrates_to_one(spark):
    import random

    random.seed(1)
    df = spark.createDataFrame([(random.gauss(0, 1),) for _ in range(3000)], "v double")
    d = sorted((r["x"], r["density"]) for r in density(df, "v").collect())
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(d, d[1:]))
    assert abs(area - 1.0) < 0.02


def test_classify_respects_given_offsets(spark):
    # 45 minutes before sunrise is night with the default 40-minute margin, day with 60.
    from blockwise.functions.sun import sun_events_local

    base = spark.createDataFrame([(-79.99, 40.44, dt.date(2024, 6, 20))], "lon double, lat double, d date")
    rise = base.select(sun_events_local("lon", "lat", "d", "America/New_York")[0].alias("r")).first()["r"]
    t = rise - dt.timedelta(minutes=45)
    df = spark.createDataFrame(
        [("B", "c", "o", -79.99, 40.44, t, 10.0)],
        "pba3_block string, checklist_id string, observer_id string, longitude double, latitude double, "
        "observation_datetime timestamp_ntz, duration_minutes double",
    )
    assert classify_checklists(df).first()["checklist_type"] == "nocturnal"
    assert classify_checklists(df, before_min=60).first()["checklist_type"] == "diurnal"
    _ = F


def test_old_atlas_matrix_rules(spark):
    from blockwise.plans.compare import old_atlas_from_matrix

    wide = spark.createDataFrame(
        [("1", "B1", "n1", "Observed/Possible", None, "Confirmed", "Probable")],
        "block string, pba3_block string, block_name string, `House Wren` string, `Blue Jay` string, "
        "`N/A sp` string, `Late Col` string",
    )
    out = {(r["common_name"], r["pba2_breeding_category_max"], r["pba2_breeding_rank_max"])
           for r in old_atlas_from_matrix(wide, ["block", "pba3_block", "block_name"], keep_first=6).collect()}
    # renamed to the new taxonomy, recoded, blank kept as NULL, "N/A" column and columns past 6 dropped
    assert out == {("Northern House Wren", "Observed", 1), ("Blue Jay", None, None)}


def test_density_constant_zero_group(spark):
    df = spark.createDataFrame([(0.0,)] * 10, "v double")
    d = density(df, "v").collect()
    assert len(d) > 0 and all(math.isfinite(r["density"]) for r in d)
