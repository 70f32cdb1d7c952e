"""Reproducible sampling and top-k.

Random numbers come from the MD5 of a seed and the row key, so a sample does
not change with partitioning, retries or executor loss, and any engine with
MD5 can draw the same one.

A sample reads its input twice, whatever its size: the first pass builds a
mergeable quantile sketch of the keys (KLL), which brackets the cut; the second
stores the rows above the lower bracket. The exact cut is then found among the
stored rows between the brackets. Counts decide whether the brackets hold, so
the result is exact even when the sketch is not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.operators.joins import join_on
from blockwise.session import materialize

_BUCKETS = 1024
#: Size of the sketches: rank error about 0.1 % for a whole table, 1.3 % for a group.
_TABLE_K, _GROUP_K = 4096, 256
_MARGIN = 0.004
_RUNG, _RUNGS = 0.8, 20


def hash_uniform(cols: Sequence[str | Column], seed: int) -> Column:
    """Uniform double in (0, 1) from the key columns and a seed: the first 13 hex digits of an MD5."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def top_k(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """``arrange(...) |> head(n)``: distributed partial top-k, then merge."""
    return df.orderBy(*order).limit(n)


def top_n_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly the ``n`` rows with the largest ``key`` (a finite double), ties settled by a hash of the whole row.

    A sketch brackets the key at the cut, the rows above the lower bracket are
    stored, and histogram passes (one aggregate of 1,024 counts each) over the
    stored rows between the brackets narrow the cut down to one value. If several
    rows share that value, the same search runs once more among them on their row
    hash, so no ordered take of an unbounded number of rows is needed. Rows equal
    in every column are interchangeable, and only among those a plain limit decides.
    """
    if n <= 0:
        return df.limit(0)
    rows, sketch = df.agg(F.count(F.lit(1)), F.kll_sketch_agg_double(key, _TABLE_K)).first()  # a bounded sketch
    if rows <= n:
        return df
    cut = 1 - n / rows
    ranks = [F.lit(min(1.0, max(0.0, cut + d))) for d in (-_MARGIN, _MARGIN)]
    lo, hi = df.sparkSession.range(1).select(*[F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), r) for r in ranks]).first()
    k = F.col(key)
    kept = materialize(df.where(k >= lo), "sample")
    above, found = kept.agg(F.count_if(k > hi), F.count(F.lit(1))).first()
    if found < n:  # the sketch missed the lower bracket
        kept, above = materialize(df, "sample"), n + 1
    sure, open_ = (F.lit(False), kept) if above > n else (k > hi, kept.where(k <= hi))
    need = n if above > n else n - above
    if not need:
        return kept.where(sure)
    over, edge, need = _cut(open_, k, need)
    if edge is None:
        return kept
    inside = F.lit(True) if above > n else k <= hi
    out, tied = kept.where(sure | (inside & over)), open_.where(edge)
    if tied.limit(need + 1).count() <= need:
        return out.unionByName(tied)
    above, edge, need = _cut(tied, _row_uniform(df), need)
    out = out.unionByName(tied.where(above))
    return out if edge is None else out.unionByName(tied.where(edge).limit(need))


def _row_uniform(df: DataFrame) -> Column:
    return hash_uniform([F.col(f"`{c}`") for c in df.columns], 1)


def _cut(df: DataFrame, k: Column, n: int) -> tuple[Column, Column | None, int]:
    """(rows above the cut value, rows at it, how many of those are wanted); no cut if ``df`` has at most ``n`` rows."""
    first = df.agg(F.min(k), F.max(k), F.count(F.lit(1))).first()
    lo, hi, rows = first
    if rows <= n:
        return F.lit(True), None, 0
    need = n
    while lo < hi:
        width = (hi - lo) / _BUCKETS
        # A bucket keeps its own smallest and largest key, so the next pass starts from exact values.
        b = F.least(F.floor((k - lo) / width), F.lit(_BUCKETS - 1)).cast("int") if width > 0 else (k > lo).cast("int")
        window = (k >= lo) & (k <= hi)
        hist = df.where(window).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi"))
        for r in sorted(hist.collect(), key=lambda r: -r["b"]):
            if r["n"] >= need:
                lo, hi = r["lo"], r["hi"]
                break
            need -= r["n"]
    return k > lo, k == lo, need


def sample_prop(df: DataFrame, prop: float, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``slice_sample(prop=)``: exactly ``floor(prop * rows)`` rows, hash-random."""
    n = int(prop * df.count())
    keyed = df.withColumn("__u", hash_uniform(key_cols, seed))
    return top_n_by_key(keyed, "__u", n).drop("__u")


def sample_weighted(df: DataFrame, n: int, weight: str, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Weighted sample without replacement (Efraimidis-Spirakis: largest ``ln(u) / w``).

    The logarithm keeps all digits for small and large weights, so the draw does
    not depend on the scale of the weights (scaling scales every key alike).
    Rows whose weight is <= 0, NULL or NaN are never drawn.
    """
    keyed = df.where((F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double"))).withColumn("__u", F.ln(hash_uniform(key_cols, seed)) / F.col(weight).cast("double"))
    return top_n_by_key(keyed, "__u", n).drop("__u")


def sample_weighted_prop(df: DataFrame, prop: float, weight: str, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``slice_sample(prop=, weight_by=)``."""
    return sample_weighted(df, int(prop * df.count()), weight, key_cols, seed)


def sample_per_group(
    df: DataFrame, group: Sequence[str], n: int, key_cols: Sequence[str], seed: int = 42, slack: float = 3.0
) -> DataFrame:
    """``group_by(g) |> slice_sample(n)``: exactly the ``n`` smallest hash keys per group.

    One aggregate gives each group's size and a sketch of its keys (the NULL group counts as a group);
    the key at rank ``slack * n`` is the group's cut. The second pass stores the rows below their group's
    cut, about ``slack * n`` per group, and only those reach the final window — a group holding a third of
    the data is never sorted or gathered in one task. The cut is exact: a group that kept fewer than
    ``min(n, size)`` rows (the sketch misjudged it) is read again without a cut.
    """
    group = list(group)
    keyed = df.withColumn("__u", hash_uniform(key_cols, seed))
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("__N"), F.kll_sketch_agg_double("__u", _GROUP_K).alias("__s"))
    # Quantiles at a ladder of ranks; a group takes the lowest rung that is not below its own rank.
    rank = F.lit(float(slack * n)) / F.col("__N") + F.lit(0.02)
    rungs = F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(_RUNG**i) for i in range(_RUNGS)]))
    rung = F.least(F.floor(F.ln(rank) / math.log(_RUNG)).cast("int"), F.lit(_RUNGS - 1))
    cut = F.when(rank < 1, F.element_at(rungs, rung + 1)).otherwise(F.lit(1.0))
    cuts = materialize(sizes.select(*group, "__N", cut.alias("__cut")), "sample-cuts")
    cand = materialize(join_on(keyed, cuts, group, null_safe=True).where(F.col("__u") <= F.col("__cut")).drop("__cut"), "sample-rows")
    kept = cand.groupBy(*group).agg(F.count(F.lit(1)).alias("__c"))
    short = join_on(cuts, kept, group, "left", null_safe=True).where(F.coalesce("__c", F.lit(0)) < F.least(F.lit(n), F.col("__N"))).select(*group, "__N")
    if not short.isEmpty():
        whole = join_on(keyed, short, group, null_safe=True)
        cand = join_on(cand, short, group, "left_anti", null_safe=True).unionByName(whole)
    w = Window.partitionBy(*group).orderBy("__u", _row_uniform(df))
    return cand.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__u", "__N", "__r")
