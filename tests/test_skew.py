"""Hot-key data: one block holds 40 % of the observations.

The fused, grain-first summary must equal the branch-by-branch definition
computed straight from the fanned-out observations.
"""

from pyspark.sql import functions as F

from blockwise.plans import season as SE
from blockwise.plans.clean import modal_start_times
from blockwise.plans.effort import classify_checklists, day_night_effort
from blockwise.sources import fixtures as fx

SF001 = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(None if v is None else (round(v, 6) if isinstance(v, float) else v) for v in r) for r in df.select(*cols).collect())


def test_fused_summary_equals_branches_on_hot_block(spark):
    o = fx.observations(spark, SF001)
    hot = o.withColumn(
        "pba3_block", F.when(F.xxhash64("checklist_id") % 5 < 2, F.lit("HOT")).otherwise(F.col("pba3_block"))
    )
    noct = fx.nocturnal_species(spark, SF001)
    fused = SE.block_season_metrics(hot, noct, nested=False, grains=SE.summary_grains(hot, persist=False))
    fan = SE.season_fanout(hot)
    fixed = modal_start_times(hot)
    keys = ["season", "pba3_block"]
    parts = {
        "checklist_count": SE.checklist_count(fan),
        "species_observed": SE.species_observed(fan),
        "birders": SE.birders(fan),
        "duration_hours_total": SE.effort_two_level(fan),
        "Confirmed": SE.species_by_max_category(fan),
        "nocturnal_species_coded": SE.nocturnal_coded(fan, noct),
        "breeding_season_months_covered": SE.season_coverage(fan),
        "duration_hours_nocturnal": day_night_effort(fan, fixed, group=["season"], nested=False),
    }
    for col, df in parts.items():
        assert _rows(fused.where(F.col(col).isNotNull()), keys + [col]) == _rows(df.where(F.col(col).isNotNull()), keys + [col]), col
    share = fused.where(F.col("season") == "All seasons").agg(
        (F.max(F.when(F.col("pba3_block") == "HOT", F.col("checklist_count"))) / F.sum("checklist_count")).alias("s")
    ).first()["s"]
    assert share > 0.33


def test_per_season_equals_fan_first(spark):
    """Keys whose rows lie in one month, in several months of different seasons, and in no month."""
    import datetime as dt

    rows = [
        ("B", "c1", -79.9, 40.4, 4, dt.datetime(2024, 4, 2, 6, 0), 30.0, 1.0),
        ("B", "c1", -79.9, 40.4, 12, dt.datetime(2024, 12, 2, 23, 0), 50.0, None),  # same place, another month
        ("B", "c2", -79.9, 40.4, 6, dt.datetime(2024, 6, 1, 12, 0), None, 2.0),
        ("B", "c4", -79.9, 40.4, 10, None, None, None),
        ("B", "c5", None, 40.4, None, dt.datetime(2024, 6, 1, 12, 0), 5.0, 2.0),  # no month: in no season
        (None, "c3", -79.9, 40.4, 1, None, 10.0, 0.5),
        (None, None, -79.9, 40.4, 1, None, 10.0, 0.5),
    ]
    g = spark.createDataFrame(
        rows,
        "pba3_block string, checklist_id string, longitude double, latitude double, observation_month_num int, "
        "observation_datetime timestamp_ntz, duration_minutes double, effort_distance_km double",
    )

    def same(a, b):
        assert sorted(map(tuple, a.select(*b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)

    a = SE.place_rows(g)
    same(a, classify_checklists(SE.season_fanout(g), None, ["season"]))
    assert a.count() == 10  # c1: All seasons, Breeding (Apr), Winter (Dec); c2: 2; c4: 1; c3 and the missing id: 2 each
    assert SE.place_rows(g, "Winter").count() == 3
    fan = SE.season_fanout(g)
    per = fan.groupBy("season", "pba3_block", "checklist_id").agg(F.max("duration_minutes").alias("d"), F.max("effort_distance_km").alias("k"))
    same(SE.checklist_rows(g), per)


def test_start_repair_equals_brute_force(spark):
    import datetime as dt
    import itertools

    t = [dt.datetime(2024, 5, 1, h, 0) for h in (5, 6, 7)]
    rows = [(b, f"c{i}", o, x) for i, (o1, o2, o3) in enumerate(itertools.product(["a", "a,b", None], repeat=3)) for b, o, x in (("B", o1, t[0]), ("B", o2, t[1]), ("C", o3, t[1]), ("B", o1, None if i % 2 else t[2]))]
    rows += [("B", "one", "a", t[0]), ("B", None, "a", t[0]), ("B", None, "a", t[1]), ("B", "half", "a", None), ("B", "half", "b", t[2])]
    df = spark.createDataFrame(rows, "pba3_block string, checklist_id string, observer_id string, observation_datetime timestamp_ntz")
    want = {}
    for cid in {r[1] for r in rows if r[1]}:
        mine = {(b, o, x) for b, c, o, x in rows if c == cid}
        if len({x for _, _, x in mine}) > 1:
            votes = [x for _, o, x in mine for _ in (o or "x").split(",") if x]
            want[cid] = min(votes, key=lambda x: (-votes.count(x), x))
    got = {r.checklist_id: r.observation_datetime_fixed for r in modal_start_times(df).collect()}
    assert got == want and len(got) > 20


def test_summary_with_polygons_null_rule(spark):  # T1
    polys = spark.createDataFrame([("P1", "B1"), ("P2", None)], "pba2_block string, pba3_block string")
    summ = spark.createDataFrame([("B1", "All seasons", 5), (None, "All seasons", 7)], "pba3_block string, season string, n long")
    strict = {(r["pba2_block"], r["n"]) for r in SE.summary_with_polygons(polys, summ).collect()}
    dplyr = {(r["pba2_block"], r["n"]) for r in SE.summary_with_polygons(polys, summ, null_safe=True).collect()}
    assert strict == {("P1", 5), ("P2", None)}
    assert dplyr == {("P1", 5), ("P2", 7)}  # the unmatched polygon takes the NULL block's summary
