"""Property and micro-table tests of the domain jobs."""

import datetime as dt

from pyspark.sql import functions as F

from blockwise.functions.geo import covers
from blockwise.operators.sampling import sample_per_group, top_n_by_key
from blockwise.plans import expected as EX
from blockwise.plans.clean import modal_start_times
from blockwise.plans.effort import classify_checklists, sun_times
from blockwise.plans.season import season_fanout
from blockwise.plans.spatial import covers_join, hull_and_point
from blockwise.plans.stats import log_spaced

SF001 = "/root/testdata/sf0.001"


def test_sun_times_pittsburgh_midsummer(spark):
    df = spark.createDataFrame([(-79.99, 40.44, dt.datetime(2024, 6, 20, 12, 0))], "longitude double, latitude double, observation_datetime timestamp_ntz")
    r = sun_times(df).first()
    assert abs((r["sunrise"] - dt.datetime(2024, 6, 20, 5, 49, 44)).total_seconds()) < 120
    assert abs((r["sunset"] - dt.datetime(2024, 6, 20, 20, 53, 31)).total_seconds()) < 120


def test_day_night_bounds_inclusive(spark):
    base = [(-79.99, 40.44, dt.datetime(2024, 6, 20, 12, 0)), (-79.99, 40.44, dt.datetime(2024, 6, 20, 1, 0)), (-79.99, 40.44, None)]
    rows = [("B", f"c{i}", "o", lon, lat, t, 30.0) for i, (lon, lat, t) in enumerate(base)]
    df = spark.createDataFrame(rows, "pba3_block string, checklist_id string, observer_id string, longitude double, latitude double, observation_datetime timestamp_ntz, duration_minutes double")
    got = {r["checklist_id"]: r["checklist_type"] for r in classify_checklists(df).collect()}
    assert got == {"c0": "diurnal", "c1": "nocturnal", "c2": "unknown"}


def test_mode_weighted_by_observers(spark):  # T12
    t1, t2 = dt.datetime(2024, 5, 1, 6, 0), dt.datetime(2024, 5, 1, 7, 0)
    rows = [("B", "c", "a,b,c", t1), ("B", "c", "d", t2), ("B", "c", "e", t2)]
    df = spark.createDataFrame(rows, "pba3_block string, checklist_id string, observer_id string, observation_datetime timestamp_ntz")
    assert modal_start_times(df).first()["observation_datetime_fixed"] == t1


def test_season_fanout_equals_semi_joins(spark):
    from blockwise.sources.fixtures import observations

    o = observations(spark, SF001)
    fan = season_fanout(o).groupBy("season").count().collect()
    by = {r["season"]: r["count"] for r in fan}
    assert by["All seasons"] == o.count()
    assert by["Breeding"] == o.where(F.col("observation_month_num").between(4, 8)).count()
    assert by["Winter"] == o.where(F.col("observation_month_num").isin(12, 1, 2)).count()


def test_expected_species_algebra_equals_brute_force(spark):
    import pandas as pd

    rows = [("B1", "c1", "sp1", 5, "X"), ("B1", "c1", "sp1", 5, None), ("B1", "c2", "sp2", 6, "3"), ("B1", "c3", "sp1", 6, "2"),
            ("B2", "c9", "sp1", 4, "1"), ("B1", "c4", "sp3", 9, "1")]
    df = spark.createDataFrame(rows, "pba3_block string, checklist_id string, common_name string, observation_month_num int, observation_count string")
    got = {(r["pba3_block"], r["common_name"], r["month_num"]): (r["observations"], r["checklist_count"], round(r["observed_pct"], 9))
           for r in EX.expected_species(df).collect()}
    p = pd.DataFrame(rows, columns=["b", "c", "s", "m", "n"])
    p = p[p.m.isin([4, 5, 6, 7, 8])]
    p["v"] = p.n.map(lambda x: None if x is None else (1.0 if x == "X" else float(x)))
    want = {}
    for b, g in p.groupby("b"):
        cl, sp = sorted(set(g.c)), sorted(set(g.s))
        for s in sp:
            for m in [4, 5, 6, 7, 8]:
                vals = []
                for c in cl:
                    hit = g[(g.c == c) & (g.s == s) & (g.m == m)]
                    vals += list(hit.v) if len(hit) else [None]
                obs = sum(v is not None and v == v for v in vals)
                want[(b, s, m)] = (obs, len(cl), round(obs / len(vals), 9))
    assert got == want


def test_beta_binomial_mle_recovers_prior(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    n = rng.integers(20, 200, 3000)
    p = rng.beta(2.0, 8.0, 3000)
    x = rng.binomial(n, p)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, n)], "observations long, checklist_count long")
    a, b = EX.beta_binomial_mle(df)
    assert abs(a - 2.0) < 0.4 and abs(b - 8.0) < 1.6


def test_hull_contains_all_points_and_point_inside(spark):
    import random

    random.seed(3)
    pts = [("g", random.uniform(0, 10), random.uniform(0, 5)) for _ in range(2000)] + [("h", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g string, longitude double, latitude double")
    hp = hull_and_point(df, "g")
    chk = df.join(hp.select("g", "ring"), "g").where(~covers("ring", "longitude", "latitude"))
    assert chk.count() == 0
    inside = hp.where(F.col("g") == "g").select(covers("ring", "px", "py").alias("c")).first()["c"]
    assert inside
    assert hp.where(F.col("g") == "h").first()["px"] == 1.0


def test_covers_boundary_and_left_keep(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    polys = spark.createDataFrame([("A", ring), ("Z", [{"x": 5.0, "y": 5.0}, {"x": 6.0, "y": 5.0}, {"x": 6.0, "y": 6.0}])], "pid string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([("in", 0.5, 0.5), ("edge", 1.0, 0.3), ("corner", 0.0, 0.0), ("out", 1.5, 0.5)], "p string, px double, py double")
    got = {(r["pid"], r["p"]) for r in covers_join(polys, pts, cell=0.25).collect()}
    assert got == {("A", "in"), ("A", "edge"), ("A", "corner"), ("Z", None)}


def test_sample_per_group_size_and_determinism(spark):
    df = spark.range(0, 5000).withColumn("g", F.when(F.col("id") < 4000, "hot").otherwise("cold"))
    s1 = sample_per_group(df, ["g"], 50, ["id"], seed=9)
    s2 = sample_per_group(df.repartition(7), ["g"], 50, ["id"], seed=9)
    assert {r["g"]: r["count"] for r in s1.groupBy("g").count().collect()} == {"hot": 50, "cold": 50}
    assert sorted(r["id"] for r in s1.collect()) == sorted(r["id"] for r in s2.collect())


def test_top_n_by_key_exact_with_ties(spark):
    df = spark.range(0, 20000).withColumn("k", (F.col("id") * 7919 % 20000) / 20000.0)
    got = top_n_by_key(df, "k", 1234)
    assert got.count() == 1234
    assert got.agg(F.min("k")).first()[0] == sorted([(i * 7919 % 20000) / 20000.0 for i in range(20000)])[-1234]
    tied = df.withColumn("k", F.floor(F.col("k") * 3) / -7.0)
    one, two = (sorted(r["id"] for r in top_n_by_key(d, "k", 9000).collect()) for d in (tied, tied.repartition(9)))
    assert one == two and len(one) == 9000


def test_weighted_sample_ignores_the_scale_of_the_weights(spark):
    from blockwise.operators.sampling import sample_weighted

    df = spark.range(0, 20000).withColumn("w", F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0))
    draws = [sorted(r["id"] for r in sample_weighted(df.withColumn("w", F.col("w") * s), 10000, "w", ["id"]).collect()) for s in (1.0, 0.0009765625, 1024.0)]
    assert draws[0] == draws[1] == draws[2]
    heavy = sum(i % 2 == 0 for i in draws[0])
    assert 6900 < heavy < 7700


def test_sample_per_group_keeps_the_null_group(spark):
    df = spark.range(0, 300).withColumn("g", F.when(F.col("id") < 200, "a"))
    got = {r["g"]: r["count"] for r in sample_per_group(df, ["g"], 20, ["id"]).groupBy("g").count().collect()}
    assert got == {"a": 20, None: 20}


def test_dashboard_rounds_before_it_compares(spark):
    from blockwise.plans.reports import dashboard_summary, with_link

    df = spark.createDataFrame([("B1", 19.996, 1.994), ("B2", 19.994, 1.996)], "pba3_block string, duration_hours_total double, duration_hours_nocturnal double")
    got = {r["pba3_block"]: (r["duration_hours_total"], r["duration_hours_nocturnal"]) for r in dashboard_summary(df).collect()}
    assert got == {"B1": (20.0, 1.99), "B2": (19.99, 2.0)}
    assert with_link(df, "u/").first()["link"] == "u/B1"


def test_extract_is_read_by_header_name(spark, tmp_path):
    import pytest

    from blockwise.sources.io import read_extract

    (tmp_path / "x.txt").write_text("OTHER\tPROJECT NAMES\tOBSERVATION DATE\tA\n1\tAtlas\t2024-05-01\tq\n2\tnone\t2024-05-02\tr\n")
    rows = read_extract(spark, str(tmp_path), "a string, observation_date date, project_names string", start="2024-01-01", project="Atlas").collect()
    assert [(r["a"], r["project_names"]) for r in rows] == [("q", "Atlas")]
    with pytest.raises(ValueError, match="no column b"):
        read_extract(spark, str(tmp_path), "b string, observation_date date, project_names string")


def test_log_spaced_matches_r():
    assert log_spaced(3, 15, 5) == [3.0, 4.0, 7.0, 10.0, 15.0]


def test_sample_per_group_exact_against_brute_force(spark):
    from pyspark.sql import Window

    from blockwise.operators.sampling import hash_uniform

    df = spark.range(0, 3000).withColumn(
        "g", F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2990, "mid").otherwise("tiny")
    )
    w = Window.partitionBy("g").orderBy("u")
    brute = (
        df.withColumn("u", hash_uniform(["id"], 5))
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= 40)
    )
    want = sorted((r["g"], r["id"]) for r in brute.collect())
    for slack in (3.0, 0.5):  # 0.5 forces the exact redo path for short groups
        got = sorted((r["g"], r["id"]) for r in sample_per_group(df, ["g"], 40, ["id"], seed=5, slack=slack).collect())
        assert got == want
