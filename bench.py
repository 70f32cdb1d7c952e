"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stage 1 writes the processed observations to Parquet (the reference's clean
step). The headline jobs then read that Parquet, as the reference's later
scripts do. Each job is forced with the ``noop`` sink (full computation, no
driver collect), cold then warm.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from blockwise.plans import compare as cmp  # noqa: E402
from blockwise.plans.clean import modal_start_times  # noqa: E402
from blockwise.plans.effort import day_night_effort, sun_times  # noqa: E402
from blockwise.plans.expected import expected_species  # noqa: E402
from blockwise.plans.reports import completion_flags, progress_table, report_codes, report_effort  # noqa: E402
from blockwise.plans.season import block_season_summary, checklist_grain, species_grain, summary_grains  # noqa: E402
from blockwise.session import ensure_checkpoint_dir, get_session  # noqa: E402
from blockwise.sources import fixtures as fx  # noqa: E402
from blockwise.sources.io import write_observations  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session()
    base = ensure_checkpoint_dir(spark).rstrip("/")
    obs_path = f"{base}/bench-obs-{uuid.uuid4().hex}"
    times: dict[str, float] = {}

    # Clustered by checklist into several files: the test tables are a single
    # row group each, which would otherwise pin every scan to one task.
    times["clean_observations_write"] = timed(lambda: write_observations(fx.observations(spark, sf_dir), obs_path, clustered=True))
    obs = spark.read.parquet(obs_path)
    names = fx.block_names(spark, sf_dir)
    noct = fx.nocturnal_species(spark, sf_dir)
    species = sorted(r[0] for r in fx.table(spark, sf_dir, "part").select("p_name").distinct().collect())
    old = cmp.old_atlas_from_matrix(fx.old_atlas_wide(spark, sf_dir, species), ["pba3_block", "block_name"])

    def compare():
        return cmp.atlas_compare(old, cmp.new_atlas_max(species_grain(obs)), names)

    def summary():
        grains = summary_grains(obs)
        c = cmp.atlas_compare(old, cmp.new_atlas_max(grains[1]), names)
        return block_season_summary(None, noct, names, atlas_metrics=cmp.atlas_block_metrics(c), grains=grains)

    summary_path = f"{base}/bench-summary-{uuid.uuid4().hex}"

    def write_summary():
        summary().write.mode("overwrite").partitionBy("season").parquet(summary_path)
        return spark.read.parquet(summary_path)

    def dashboard():
        # What the dashboard computes at start-up from the stored summary.
        s = spark.read.parquet(summary_path)
        run(completion_flags(s))
        run(progress_table(s, "Breeding"))
        run(report_effort(s, "B3", "Breeding"))
        run(report_codes(s, "B3", "Breeding"))

    jobs = {
        "block_season_summary": write_summary,
        "sun_times": lambda: run(sun_times(obs)),
        "day_night_effort": lambda: run(day_night_effort(obs, modal_start_times(checklist_grain(obs)))),
        "expected_species": lambda: run(expected_species(obs)),
        "atlas_compare": lambda: run(compare()),
        "dashboard_from_summary": dashboard,
    }
    # A job's time includes building its plan (the summary writes its two grain
    # tables while it is built).
    for name, job in jobs.items():
        times[name] = timed(job)
    for name, job in jobs.items():
        times[f"{name}_warm"] = timed(job)

    cold = sum(v for k, v in times.items() if not k.endswith("_warm"))
    print(
        json.dumps(
            {
                "metric": "headline_jobs_cold_total",
                "value": round(cold, 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "rows_observations": spark.read.parquet(obs_path).count(),
            }
        )
    )
    _ = F


if __name__ == "__main__":
    main()
