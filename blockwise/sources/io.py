"""Readers and writers (Parquet, CSV, tab-separated extracts, polygon JSON)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.functions.semantics import MONTH_ABB

# Pattern of the release tag in an extract file name (e.g.
# "relMay-2026.txt") and the sentence the tag is shown in.
RELEASE_PATTERN = rf"({'|'.join(MONTH_ABB)})-\d{{4}}\.txt"
RELEASE_SENTENCE = "Data includes checklists from Jan-2024 to"


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lazy Parquet scan; filters and projections are pushed into the reader."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header. Give ``schema`` in production; inference is for exploration only."""
    r = spark.read.option("header", True)
    return by_header(r, path, schema) if schema is not None else r.option("inferSchema", True).csv(path)


def header_name(name: str) -> str:
    """``LAST EDITED DATE`` -> ``last_edited_date``."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def by_header(reader: DataFrameReader, path: str, schema: T.StructType | str) -> DataFrame:
    """The columns of ``schema``, found by header name (in any order, other columns left unread) and converted.

    A cell that is not of its column's type is NULL (``bad_cells`` counts them).
    Raises when a column is missing or two headers have the same name. All files
    must have the header of the first; Spark checks that while reading
    (``enforceSchema`` off).
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw, given = _as_text(reader, path, schema)
    return raw.select([F.col(given[f.name]).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def bad_cells(reader: DataFrameReader, path: str, schema: T.StructType | str) -> DataFrame:
    """(column, bad): cells of each column of ``schema`` that have text but not of the column's type; one pass."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw, given = _as_text(reader, path, schema)
    bad = [F.count_if(F.col(given[f.name]).isNotNull() & F.col(given[f.name]).try_cast(f.dataType).isNull()) for f in schema.fields]
    counts = raw.agg(F.array(*[F.struct(F.lit(f.name).alias("column"), b.alias("bad")) for f, b in zip(schema.fields, bad, strict=True)]).alias("c"))
    return counts.select(F.inline("c"))


def _as_text(reader: DataFrameReader, path: str, schema: T.StructType) -> tuple[DataFrame, dict[str, str]]:
    raw = reader.option("enforceSchema", False).option("inferSchema", False).csv(path)
    given: dict[str, list[str]] = {}
    for c in raw.columns:
        given.setdefault(header_name(c), []).append(c)
    wanted = {f.name: given.get(header_name(f.name), []) for f in schema.fields}
    if missing := [n for n, found in wanted.items() if not found]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(raw.columns)}")
    if double := [found for found in wanted.values() if len(found) > 1]:
        raise ValueError(f"{path} has several columns of one name: {double}")
    return raw, {n: f"`{found[0]}`" for n, found in wanted.items()}


def read_csv_positional(spark: SparkSession, path: str, names: Sequence[str], skip: int = 0) -> DataFrame:
    """Header-less CSV, first ``skip`` lines of each file dropped, columns named by position.

    One scan: rows come in file order, so a row's place in its split is counted
    as it streams by, and only the split that starts a file drops its first rows.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", False).csv(path)
    if skip <= 0:
        return raw
    split = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"))
    return raw.select(*[F.col(f"`{n}`") for n in names], split["f"].alias("__file"), split["at"].alias("__at")).mapInArrow(_after(skip), schema)


def _after(skip: int):
    """Drops the first ``skip`` rows of each file (a closure, so that executors need no copy of this package)."""

    def run(batches):
        import numpy as np

        here, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            *_, file, at = batch.columns
            file, at = file.to_pylist(), np.asarray(at)
            keep = np.ones(batch.num_rows, bool)
            begin = 0
            for i in [*(k for k in range(1, len(file)) if at[k] != at[k - 1] or file[k] != file[k - 1]), len(file)]:
                if here != (file[begin], at[begin]):
                    here, seen = (file[begin], at[begin]), 0
                if at[begin] == 0:
                    keep[begin : min(i, begin + max(0, skip - seen))] = False
                seen += i - begin
                begin = i
            yield batch.select(list(range(batch.num_columns - 2))).take(np.flatnonzero(keep))

    return run


def read_extract(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    date_col: str = "observation_date",
    start: str | None = None,
    end: str | None = None,
    project_col: str = "project_names",
    project: str | None = None,
) -> DataFrame:
    """Tab-separated checklist extract filtered by date range and project.

    The filter is part of the scan plan; the caller writes the result to
    Parquet (not back to text).
    """
    df = by_header(spark.read.option("sep", "\t").option("header", True).option("quote", ""), path, schema)
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date_col) <= F.lit(end).cast("date"))
    if project is not None:
        df = df.where(F.col(project_col).contains(project))
    return df


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files under ``path`` (column ``path``); no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def release_tag(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Release tag (``May-2026``) from an extract file name, and the sentence shown with it."""
    tag = F.regexp_extract(F.col(path_col), RELEASE_PATTERN, 0)
    tag = F.regexp_replace(tag, r"\.txt$", "")
    return df.select(
        F.col(path_col),
        F.when(tag != "", tag).alias("release"),
        F.when(tag != "", F.concat_ws(" ", F.lit(RELEASE_SENTENCE), tag)).alias(
            "release_sentence"
        ),
    )


def read_polygons_json(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Polygons as JSON lines ``{"<id_col>": ..., "ring": [[x, y], ...]}`` -> ring of structs."""
    schema = T.StructType(
        [T.StructField(id_col, T.StringType()), T.StructField("ring", T.ArrayType(T.ArrayType(T.DoubleType())))]
    )
    raw = spark.read.schema(schema).json(path)
    return raw.select(
        id_col, F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring")
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), refresh: bool = False) -> None:
    """Write ``df``; with ``refresh`` only the partitions that it has rows for are replaced, other files stay as they are."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if refresh else "static")
    w.parquet(path)


def write_observations(obs: DataFrame, path: str, rows_per_file: int = 20_000_000, clustered: bool = False) -> None:
    """Write processed observations: a narrow step, files bounded by ``rows_per_file``.

    ``clustered`` adds a shuffle that keeps a checklist's rows together (files of
    the advisory partition size, large partitions split by AQE), so that the
    checklist aggregate collapses them map-side.
    """
    if clustered:
        obs = obs.hint("rebalance", "checklist_id")
    obs.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv_text(df: DataFrame, path: str) -> None:
    """Everything cast to text first (``mutate(across(everything(), as.character))``)."""
    df.select([F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").option(
        "header", True
    ).csv(path)

