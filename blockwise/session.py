"""Spark session and checkpoint-folder helpers.

Library functions never build their own session: they take DataFrames. This
module is for tests, the bench script and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Instants in the observation data are wall-clock times in this zone.
LOCAL_TZ = "America/New_York"


def get_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster session is reused as is."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("blockwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only a local session without the setting (tests) gets a fresh
    scratch folder; on a cluster without it this raises, because executors
    would write to their own disks.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="blockwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


#: Manifest of the stored tables of each open ``stored_tables`` block, innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, the tables that were stored inside it; the list is their manifest.

    The creator of intermediate tables wraps its work in this: results that are
    still read lazily must be written or collected inside.
    """
    manifest: list[str] = []
    _OPEN.append(manifest)
    try:
        yield manifest
    finally:
        _OPEN.remove(manifest)
        hadoop = spark._jsc.hadoopConfiguration()
        for path in manifest:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used for small intermediate tables that several branches read (the
    checklist and species grains): computed once, columnar on re-read, and
    the lineage is cut, so a lost executor does not force a rescan of the
    observations. Inside ``stored_tables`` the table is entered in its manifest.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # the schema is known: no job reads it from the files
