"""Breaks, bins, histograms and density (M2–M6), all as Spark aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.operators.joins import join_on
from blockwise.session import materialize

# Circle sizes run from 3 to 15 on a log scale.
SIZE_MIN, SIZE_MAX = 3.0, 15.0


def log_breaks(df: DataFrame, column: str, length: int = 10) -> DataFrame:
    """``unique(round(exp(seq(log(min), log(max), length.out = length))))`` of a column.

    One scalar aggregate, then ``explode(sequence)``; half-to-even rounding (T7).
    Non-positive min or max gives no rows (the reference stops with an error).
    """
    if length < 1:
        raise ValueError(f"no breaks to make: {length}")
    mm = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).where(
        (F.col("lo") > 0) & (F.col("hi") > 0)
    )
    step = (F.ln("hi") - F.ln("lo")) / F.lit(max(length - 1, 1))
    seq = mm.select(F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"), "lo", "hi")
    val = F.bround(F.exp(F.ln("lo") + F.col("i") * step), 0)
    return seq.select(val.alias("brk")).distinct()


def log_spaced(low: float, high: float, count: int) -> list[float]:
    """Driver-side twin for a handful of numbers (circle sizes)."""
    if min(low, high) <= 0:
        raise ValueError(f"a logarithmic scale needs positive ends, not {low} and {high}")
    growth = (high / low) ** (1 / max(1, count - 1))
    return [float(round(low * growth**i)) for i in range(count)]


def step_bins(df: DataFrame, column: str, breaks: list[float]) -> DataFrame:
    """Circle size per row: size of the last break <= value (first size below the first break)."""
    breaks = sorted(breaks)
    sizes = log_spaced(SIZE_MIN, SIZE_MAX, len(breaks)) if breaks else []
    expr = F.lit(sizes[0]) if sizes else F.lit(None)
    for b, s in zip(breaks, sizes):
        expr = F.when(F.col(column) >= b, F.lit(s)).otherwise(expr)
    return df.withColumn("circle_size", expr)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]: (bin, bin_lo, bin_hi, n). The max falls in the last bin.

    Min and max come back as two scalars; the binning is one partial aggregate.
    """
    mm = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if mm is None or mm["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    lo, hi = mm["lo"], mm["hi"]
    w = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    out = df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("bin_hi"), "n"
    )


def bin_2d(df: DataFrame, x: str, y: str, dx: float, dy: float) -> DataFrame:
    """2-D bin counts on a fixed grid of cell size (dx, dy)."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.floor(F.col(x) / dx).alias("bx"), F.floor(F.col(y) / dy).alias("by"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density(df: DataFrame, column: str, group: str | None = None, points: int = 512, per_bandwidth: int = 8) -> DataFrame:
    """Gaussian kernel density per group (NULL is a group) on ``points`` grid points: (group, k, x, density).

    Bandwidths follow Silverman's rule (``bw.nrd0``), with the IQR from a bounded
    quantile summary. The rows are binned linearly once (a row's weight goes to
    its two neighbouring bins), ``per_bandwidth`` bins to the smallest bandwidth
    of all groups, which is the one number that the binning needs; so rows are
    combined map-side and never joined to their group's statistics. The bins
    meet them, and each adds to the grid points within 4 bandwidths.
    """
    if group is None:
        df = df.withColumn("__all", F.lit(0))
    g = group or "__all"
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(g).alias("g"), v.alias("v"))
    stats = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("N"),
        F.stddev_samp("v").alias("sd"),
        # Bounded-memory quantile summary (relative rank error 1e-4) for the
        # IQR of the bandwidth rule; an exact percentile keeps every distinct value.
        F.percentile_approx("v", 0.25, 10000).alias("q1"),
        F.percentile_approx("v", 0.75, 10000).alias("q3"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    lim = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    # bw.nrd0 fallbacks: min(sd, IQR/1.34), else sd, else |smallest value| (R takes the
    # first value, which has no order here), else 1 — never 0.
    lim = (
        F.when(lim > 0, lim)
        .when(F.col("sd") > 0, F.col("sd"))
        .when(F.abs(F.col("lo")) > 0, F.abs(F.col("lo")))
        .otherwise(F.lit(1.0))
    )
    stats = stats.withColumn("h", 0.9 * lim * F.pow(F.col("N"), -0.2))
    stats = stats.withColumns({"glo": F.col("lo") - 3 * F.col("h"), "ghi": F.col("hi") + 3 * F.col("h")})
    stats = materialize(stats.withColumn("gstep", (F.col("ghi") - F.col("glo")) / (points - 1)), "density-stats")
    smallest = stats.agg(F.min("h")).first()[0]
    width = (smallest or 1.0) / per_bandwidth
    place = F.col("v") / F.lit(width)
    binned = rows.groupBy("g", F.floor(place).alias("j")).agg(F.count(F.lit(1)).alias("c"), F.sum(place - F.floor(place)).alias("f"))
    both = F.array(
        F.struct(F.col("j").alias("j"), (F.col("c") - F.col("f")).alias("w")),
        F.struct((F.col("j") + 1).alias("j"), F.col("f").alias("w")),
    )
    bins = join_on(binned.select("g", F.inline(both)), stats, ["g"], null_safe=True).where("w > 0")
    bins = bins.withColumn("at", F.col("j") * F.lit(width))
    first = F.greatest(F.ceil((F.col("at") - 4 * F.col("h") - F.col("glo")) / F.col("gstep")), F.lit(0))
    last = F.least(F.floor((F.col("at") + 4 * F.col("h") - F.col("glo")) / F.col("gstep")), F.lit(points - 1))
    fan = bins.where(first <= last).withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    gx = F.col("glo") + F.col("k") * F.col("gstep")
    z = (gx - F.col("at")) / F.col("h")
    contrib = F.col("w") * F.exp(-0.5 * z * z) / (F.col("N") * F.col("h") * math.sqrt(2 * math.pi))
    out = fan.groupBy("g", "k").agg(F.first(gx).alias("x"), F.sum(contrib).alias("density"))
    return out.withColumnRenamed("g", group) if group else out.drop("g")
