"""Plan-shape checks over every registered query (sf0.001)."""

import re

import __spark_entry__ as E
from blockwise.plans import compare as cmp
from blockwise.plans import expected as EX
from blockwise.plans import season as SE
from blockwise.plans.clean import apply_start_fix, modal_start_times
from blockwise.session import materialize
from blockwise.sources import fixtures as fx
from blockwise.sources import io as IO

SF001 = "/root/testdata/sf0.001"
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = _plan(E.queries()["scan_parquet"](spark, SF001))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan  # 4 of 11 columns read
    assert "PushedFilters: [IsNotNull(l_suppkey), IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,40.0)]" in plan


def test_no_nested_loop_cartesian_or_row_udf(spark):
    bad = {}
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF001))
        hits = [w for w in FORBIDDEN if w in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def _initial(df) -> str:
    return _plan(df).split("== Initial Plan ==")[-1]


def _exchanges(df) -> int:
    """Shuffles in the plan as it is before adaptive execution, reused ones once."""
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange ", _initial(df)))


def test_summary_keeps_its_partitioning(spark):
    """C9: checklists are hashed once; start repair, places and seasons add no exchange."""
    df = E.queries()["block_season_summary"](spark, SF001)
    assert _exchanges(df) <= 25
    cg, sg = SE.summary_grains(fx.observations(spark, SF001))
    places = SE.place_rows(apply_start_fix(by := cg.repartition("checklist_id"), modal_start_times(by)))
    # the grain is hashed for the rows and for their repair: the same exchange, used twice
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", _initial(places))) == {"checklist_id"}
    assert "LeftSemi" not in _initial(places)


def _scans(df) -> int:
    return _initial(df).count("FileScan")


def test_expected_species_reads_the_observations_once(spark):
    obs = materialize(fx.observations(spark, SF001), "shape-obs")
    df = EX.expected_species(obs)
    assert _scans(df) == 1 and "Expand" in _initial(df) and "Join" not in _initial(df)
    assert _exchanges(df) <= 4


def test_atlas_comparison_reads_each_side_once(spark):
    new = cmp.new_atlas_max(materialize(fx.observations(spark, SF001).select(*SE.SPECIES_GRAIN).distinct(), "shape-species"))
    assert _scans(new) == 1 and "Join" not in _initial(new)
    old = spark.createDataFrame([], "pba3_block string, common_name string, pba2_breeding_category_max string, pba2_breeding_rank_max int")
    both = cmp.full_outer_on_keys(old, new, cmp.KEYS)
    assert _scans(both) == 1 and _initial(both).count("SortMergeJoin") == 1


def test_positional_csv_is_one_scan(spark, tmp_path):
    df = IO.read_csv_positional(spark, str(tmp_path), ["a", "b"], skip=2)
    assert _scans(df) == 1 and "Window" not in _initial(df) and "Join" not in _initial(df)
