"""Stored tables, readers, samples, grouped priors and checks added together."""

import os
import random

import pytest
from pyspark.sql import functions as F

from blockwise.operators.reshape import complete_keys
from blockwise.operators.sampling import sample_per_group, sample_prop, sample_weighted
from blockwise.plans import expected as EX
from blockwise.plans.quality import changed_types, missing_sources, one_to_one_both_ways
from blockwise.plans.stats import density
from blockwise.session import materialize, stored_tables
from blockwise.sources.io import bad_cells, read_csv_positional, read_extract, read_parquet, write_parquet


def test_stored_tables_are_removed_by_their_creator(spark):
    outer = materialize(spark.range(5), "kept")
    with stored_tables(spark) as manifest:
        inner = materialize(spark.range(3), "gone")
        with stored_tables(spark) as nested:
            materialize(spark.range(2), "gone-too")
        assert inner.count() == 3 and len(manifest) == 1 and len(nested) == 1
        assert not os.path.exists(nested[0].removeprefix("file:"))
    assert not os.path.exists(manifest[0].removeprefix("file:")) and outer.count() == 5


def test_refresh_of_one_season_leaves_other_files(spark, tmp_path):
    path = str(tmp_path / "seasons")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "season string, n int")
    write_parquet(df, path, ["season"])
    before = {f: os.stat(f).st_mtime_ns for f in (str(p) for p in (tmp_path / "seasons").rglob("*.parquet"))}
    write_parquet(df.where("season = 'b'").withColumn("n", F.col("n") * 10), path, ["season"], refresh=True)
    after = {f: os.stat(f).st_mtime_ns for f in (str(p) for p in (tmp_path / "seasons").rglob("*.parquet"))}
    assert sorted(map(tuple, read_parquet(spark, path).select("season", "n").collect())) == [("a", 1), ("b", 20), ("b", 30)]
    assert {f: t for f, t in before.items() if "season=a" in f} == {f: t for f, t in after.items() if "season=a" in f}


@pytest.mark.parametrize("skip", [0, 1, 3])
def test_positional_csv_drops_the_first_lines_of_each_file(spark, tmp_path, skip):
    want = []
    for k, n in enumerate((0, 1, 2, 3, 50, 4000)):
        lines = [f"{k},{i}" for i in range(n)]
        (tmp_path / f"f{k}.csv").write_text("".join(x + "\n" for x in lines))
        want += lines[skip:]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # the last file has several splits
    try:
        got = [f"{r.a},{r.b}" for r in read_csv_positional(spark, str(tmp_path), ["a", "b"], skip).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted(want)


def test_malformed_cells_are_null_and_counted(spark, tmp_path):
    (tmp_path / "x.txt").write_text("B\tA NUMBER\tOBSERVATION DATE\nq\t1.5\t2024-05-01\nr\tn/a\t2024-05-02\ns\t\tsoon\n")
    schema = "a_number double, observation_date date, b string"
    rows = {r.b: (r.a_number, str(r.observation_date)) for r in read_extract(spark, str(tmp_path), schema).collect()}
    assert rows == {"q": (1.5, "2024-05-01"), "r": (None, "2024-05-02"), "s": (None, "None")}
    reader = spark.read.option("sep", "\t").option("header", True)
    assert {r.column: r.bad for r in bad_cells(reader, str(tmp_path), schema).collect()} == {"a_number": 1, "observation_date": 1, "b": 0}
    (tmp_path / "x.txt").write_text("A NUMBER\ta_number\tOBSERVATION DATE\tB\n1\t2\t2024-05-01\tq\n")
    with pytest.raises(ValueError, match="several columns of one name"):
        read_extract(spark, str(tmp_path), schema)


def test_samples_do_not_depend_on_partitioning_and_skip_nan_weights(spark):
    df = spark.range(0, 30000).selectExpr("id", "id % 3 AS g", "CASE WHEN id % 10 = 0 THEN cast('NaN' AS double) WHEN id % 10 = 1 THEN NULL ELSE 1.0 + id % 5 END AS w")
    for draw in (lambda d: sample_prop(d, 0.3, ["id"]), lambda d: sample_weighted(d, 5000, "w", ["id"]), lambda d: sample_per_group(d, ["g"], 2000, ["id"])):
        one, two = (sorted(r.id for r in draw(d).collect()) for d in (df, df.repartition(11)))
        assert one == two and len(one) == len(set(one)) and len(one) in (9000, 5000, 6000)
    assert sample_weighted(df, 40000, "w", ["id"]).where("id % 10 < 2").count() == 0


def test_priors_of_several_groups(spark):
    import numpy as np

    rng, rows = np.random.default_rng(5), []
    for g, (a, b) in {"one": (2.0, 8.0), None: (6.0, 3.0)}.items():
        n = rng.integers(20, 200, 2000)
        rows += [(g, int(x), int(k)) for x, k in zip(rng.binomial(n, rng.beta(a, b, 2000)), n)]
    rows += [("flat", 5, 10)] * 20  # equal rates: the likelihood has no maximum
    df = spark.createDataFrame(rows, "g string, observations long, checklist_count long")
    got = {r.g: r for r in EX.beta_binomial_priors(df, "g", max_steps=25).collect()}
    assert got["one"].converged and abs(got["one"].alpha - 2) < 0.4 and abs(got["one"].beta - 8) < 1.6
    assert got[None].converged and abs(got[None].mean - 2 / 3) < 0.02
    assert not got["flat"].converged
    alone = EX.beta_binomial_mle(df.where("g = 'one'"))
    assert abs(alone[0] - got["one"].alpha) < 1e-6


def test_density_keeps_the_null_group_and_follows_the_data(spark):
    import math

    random.seed(1)
    rows = [(None, random.gauss(0, 1)) for _ in range(3000)] + [("narrow", random.gauss(5, 0.01)) for _ in range(2000)] + [("x", None), ("narrow", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {}
    for r in density(df, "v", group="g").collect():
        out.setdefault(r.g, []).append((r.x, r.density))
    assert out.keys() == {None, "narrow"}
    for d in out.values():
        d.sort()
        assert abs(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(d, d[1:])) - 1) < 0.02
    top = max(out[None], key=lambda e: e[1])
    assert abs(top[1] - 1 / math.sqrt(2 * math.pi)) < 0.04 and abs(max(out["narrow"], key=lambda e: e[1])[0] - 5) < 0.01


def test_checks_on_relations_types_and_sources(spark, tmp_path):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", None), ("c", 3), (None, 4), ("d", 5)], "l string, r int")
    got = {(r.side, r.id): (r.partners, r.partners_with_null) for r in one_to_one_both_ways(pairs, "l", "r").collect()}
    assert got == {("l", "a"): (2, 2), ("r", "1"): (2, 2), ("l", "c"): (1, 2)}
    a = spark.createDataFrame([], "x timestamp_ntz, y int")
    assert [tuple(r) for r in changed_types(a, a.selectExpr("cast(x as timestamp) x", "y")).collect()] == [("x", "timestamp_ntz", "timestamp")]
    (tmp_path / "there.txt").write_text("x")
    assert [r.path for r in missing_sources(spark, [str(tmp_path), str(tmp_path / "no.txt")]).collect()] == [str(tmp_path / "no.txt")]


def test_complete_keys(spark):
    df = spark.createDataFrame([("a", 1, "x", 5), ("b", 2, None, 7)], "k string, m int, c string, n long")
    got = {(r.k, r.m, r.c): r.n for r in complete_keys(df, "k", ["m", "c"], {"n": 0}).collect()}
    assert len(got) == 8 and got["a", 1, "x"] == 5 and got["b", 2, None] == 7 and sum(got.values()) == 12
    with pytest.raises(ValueError, match="more than 1 values"):
        complete_keys(df, "k", ["m"], {}, most=1)
