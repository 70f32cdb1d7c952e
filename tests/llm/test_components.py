"""Components of links: closed step by step, in plans that stay small for the driver."""

import random

from blockwise.llm import components as module
from blockwise.llm.components import components

LINKS = "a long, b long"
CHAIN = [(i, i + 1) for i in range(0, 40, 2)] + [(i, i + 1) for i in range(1, 40, 2)]


def _brute(links):
    low = {n: n for link in links for n in link if link[0] != link[1]}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    return sorted(low.items())


def _rows(df):
    return sorted(tuple(r) for r in df.select("node", "root").collect())


def test_new_links_are_closed_over_earlier_roots(spark):
    draw = random.Random(3)
    first = [(draw.randrange(60), draw.randrange(60)) for _ in range(30)] + [(100, 101), (7, 7)]
    then = [(draw.randrange(60), draw.randrange(60)) for _ in range(8)] + [(101, 200), (300, 301), (301, 302)]
    roots = components(spark.createDataFrame(first, LINKS))
    assert _rows(roots) == _brute(first)
    assert _rows(components(spark.createDataFrame(then, LINKS), roots)) == _brute(first + then)
    none = spark.createDataFrame([], LINKS)
    assert _rows(components(none, roots)) == _brute(first)
    assert _rows(components(none)) == [] and _rows(components(spark.createDataFrame(then, LINKS), components(none))) == _brute(then)


def test_no_plan_holds_more_than_a_step(spark, monkeypatch):
    plans = []

    def fixed(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return stored(df, tag)

    stored = module.fixed
    monkeypatch.setattr(module, "fixed", fixed)
    assert _rows(components(spark.createDataFrame(CHAIN, LINKS))) == [(i, 0) for i in range(41)]
    assert max(plans) <= 8, plans


def test_stored_tables_are_read_without_a_job(spark):
    from blockwise.session import materialize

    df = spark.range(3).selectExpr("id", "array(named_struct('x', cast(id as string))) as s", "cast(null as date) as d")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stored", "stored")
    try:
        out = materialize(df, "stored")
        jobs = len(tracker.getJobIdsForGroup("stored"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1
    assert out.dtypes == df.dtypes and out.orderBy("id").collect() == df.orderBy("id").collect()
