"""Exact duplicates by content sort (DataFrame operations only).

Sampled splitters range-partition the normalised texts (by their first
``HEAD`` characters, then a hash of the rest, so that the sample which goes to
the driver stays small), each partition is sorted, equal texts become
neighbours and a window over them compares the full normalised bytes. A text that holds more than a thousandth of all rows is
spread over ``salts`` sort keys, and the at most ``salts`` winners of each such
text are compared once more.

Defined results: a null text equals an empty one; of equal texts the row with
the most code points in its original text stays, then the smallest id, a null
id last; of rows equal in all of that exactly one has ``kept``. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.llm.common import WS_RUN, fixed, frequent_keys, text_or_empty


#: Characters of the normalised text that a splitter holds.
HEAD = 48


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), WS_RUN, "")


def _sorted_groups(docs: DataFrame, id_col: str, text_col: str, extra: list[str], hot_share: float, salts: int) -> DataFrame:
    """Every row with its place among the equal texts of its sort key."""
    base = docs.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_x_{i}") for i, c in enumerate(extra)],
        F.char_length(text_or_empty(text_col)).cast("long").alias("_chars"),
        normalised(text_col).alias("_norm"),
    ).withColumns({"_key": F.xxhash64("_norm"), "_head": F.substring("_norm", 1, HEAD)})
    hot = frequent_keys(base, "_key", hot_share)
    is_hot = F.col("_key").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(salts))).otherwise(F.lit(-1))
    order = [F.col("_chars").desc(), F.col("_id").asc_nulls_last()]
    same = ["_head", "_key", "_norm", "_salt"]
    whole = Window.partitionBy(*same).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        base.withColumn("_salt", salt.cast("int"))
        .repartitionByRange("_head", "_key", "_salt")
        .select(
            "*",
            F.row_number().over(Window.partitionBy(*same).orderBy(*order)).alias("_rank"),
            F.first("_id").over(whole).alias("_keep"),
            F.count(F.lit(1)).over(whole).alias("_size"),
        )
        .withColumn("_sha", F.sha2("_norm", 256))
        .drop("_norm", "_head", "_key")
    )


def _with_winners(part: DataFrame) -> DataFrame:
    """Settle the texts that were spread over several sort keys (at most 1 / hot_share texts, ``salts`` rows each)."""
    settled = (
        part.where("_salt >= 0 and _rank = 1")
        .groupBy("_sha")
        .agg(
            F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_salt").alias("s"))).alias("_first"),
            F.sum("_size").alias("_total"),
        )
    )
    return (
        part.join(F.broadcast(settled), "_sha", "left")
        .withColumn("_kept", (F.col("_rank") == 1) & (F.col("_first").isNull() | (F.col("_first.s") == F.col("_salt"))))
        .withColumn("_keep", F.when(F.col("_first").isNull(), F.col("_keep")).otherwise(F.col("_first.i")))
        .withColumn("_size", F.coalesce("_total", "_size"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001, salts: int = 64) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised text)."""
    part = fixed(_sorted_groups(docs, id_col, text_col, [], hot_share, salts), "exact-dedup")
    return _with_winners(part).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001, salts: int = 64) -> DataFrame:
    """The kept rows with all their columns."""
    names = docs.columns
    part = _sorted_groups(docs, id_col, text_col, names, hot_share, salts).where("_rank = 1")
    rows = _with_winners(fixed(part, "exact-dedup-rows"))
    return rows.where("_kept").select(*[F.col(f"_x_{i}").alias(c) for i, c in enumerate(names)])
