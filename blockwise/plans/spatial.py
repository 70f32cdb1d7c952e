"""Spatial jobs: convex hull and interior point per group (G3/G4), polygon-covers-point
join (G5/J9), Web Mercator and bounding box (G7/G8), old↔new block crosswalk (G10).

The hull is exact without sampling. One aggregate per (group, x) keeps the
lowest and highest y, the only points of that x that can be vertices; slices of
bounded size return their own hulls, and slices of those are taken until a group
fits one slice, so no task holds more than a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.geo import covers_edges, ring_bbox, ring_edges, web_mercator
from blockwise.operators.joins import join_on, union_rows
from blockwise.session import materialize

#: Points of a hull slice.
SLICE = 10_000
#: Points that one cell of the polygon join may hold, and how often a cell may be halved on the way there.
CELL_POINTS = 20_000
CELL_DEPTH = 10


def _geometry_helpers():
    """Hull and interior-point helpers, built inside a function so that the
    pandas functions that use them are shipped to executors by value (no
    import of this package is needed on the workers)."""
    import numpy as np

    def _straight_or_right(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each inner point does not turn left from its predecessor to its successor.

        Doubles decide beyond their error bound; the rest is decided in whole
        numbers of 1e-12, the decimals that coordinates stand for.
        """
        left, right = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]), (y[1:-1] - y[:-2]) * (x[2:] - x[:-2])
        out = left <= right
        reach = [np.abs(v[:-2]) + np.abs(v[1:-1]) + np.abs(v[2:]) for v in (x, y)]
        near = np.flatnonzero(np.abs(left - right) <= reach[0] * reach[1] * 2.0**-50)
        if len(near):
            whole = [np.array([round(float(z) * 10**12) for z in v[i]], object) for v in (x, y) for i in (near, near + 1, near + 2)]
            x0, x1, x2, y0, y1, y2 = whole
            out[near] = ((x1 - x0) * (y2 - y0) <= (y1 - y0) * (x2 - x0)).astype(bool)
        return out

    def _lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the lower chain. A point on or above the line between two others is no vertex, whatever becomes of those."""
        at = np.arange(len(x))
        while len(at) > 2:
            gone = _straight_or_right(x[at], y[at])
            if not gone.any():
                break
            at = at[np.concatenate([[True], ~gone, [True]])]
        return at

    def _hull(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Convex hull counter-clockwise from the leftmost (lowest) point, no repeated end point."""
        pts = np.unique(np.column_stack([xs, ys]), axis=0)
        if len(pts) <= 2:
            return pts
        x, y = pts[:, 0], pts[:, 1]
        lower, back = _lower(x, y), _lower(-x[::-1], -y[::-1])
        upper = len(x) - 1 - back
        return pts[np.concatenate([lower[:-1], upper[:-1]])]

    def _interior_point(h: np.ndarray) -> tuple[float, float]:
        """Point on surface of a convex ring: middle of the scan line between the vertex
        heights nearest the envelope centre; a point or segment gives its first point."""
        if len(h) <= 2:
            return float(h[0][0]), float(h[0][1])
        x, y = h[:, 0], h[:, 1]
        lo_y, hi_y = y.min(), y.max()
        centre = (lo_y + hi_y) / 2
        below = y[(y <= centre) & (y > lo_y)]
        above = y[(y > centre) & (y < hi_y)]
        lo = below.max() if len(below) else lo_y
        hi = above.min() if len(above) else hi_y
        at = (lo + hi) / 2
        x2, y2 = np.roll(x, -1), np.roll(y, -1)
        cut = (y > at) != (y2 > at)
        if cut.sum() < 2:
            return float(x[0]), float(at)
        hits = x[cut] + (at - y[cut]) * (x2[cut] - x[cut]) / (y2[cut] - y[cut])
        return float((hits.min() + hits.max()) / 2), float(at)

    return _hull, _interior_point


def hull_and_point(points: DataFrame, group: str, x: str = "longitude", y: str = "latitude", slice_points: int = SLICE) -> DataFrame:
    """(group, hull ring ``ARRAY<STRUCT<x,y>>``, interior point px/py, distinct point count).

    Rows without a group or a coordinate are left out. A hull that itself has
    more than ``slice_points`` vertices is one value of the result, whatever its size.
    """
    pts = points.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    columns = pts.distinct().groupBy("g", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("n"))
    columns = materialize(columns, "hull-columns")
    counts = columns.groupBy("g").agg(F.sum("n").alias("n_points"))
    left = columns.select("g", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    _hull, _interior_point = _geometry_helpers()
    kind = pts.schema["g"].dataType.simpleString()

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({"g": pdf["g"].iloc[0], "x": h[:, 0], "y": h[:, 1]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        px, py = _interior_point(h)
        ring = [{"x": float(a), "y": float(b)} for a, b in h]
        if len(ring) > 2:
            ring.append(ring[0])
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "ring": [ring], "px": [px], "py": [py]})

    before = None
    while True:
        sizes = left.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
        most, rows = sizes.agg(F.max("k"), F.sum("k")).first()
        if most is None or most <= slice_points or rows == before:
            break
        before = rows
        slices = sizes.select("g", F.ceil(F.col("k") / F.lit(slice_points)).cast("int").alias("slices"))
        dealt = left.join(slices, "g").withColumn("slice", F.pmod(F.xxhash64("x"), F.col("slices")).cast("int"))
        left = materialize(dealt.groupBy("g", "slice").applyInPandas(partial, f"g {kind}, x double, y double"), "hull-slices")
    schema = f"g {kind}, ring array<struct<x:double,y:double>>, px double, py double"
    out = left.groupBy("g").applyInPandas(final, schema)
    return out.join(counts, "g").withColumnRenamed("g", group)


def _cell_index(column: str | Column, size: float) -> Column:
    """Whole number of the cell: one formula for points and polygons, so that rounding cannot part them."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / size).cast("long")


def polygon_cells(polys: DataFrame, cell: float, depth: int = CELL_DEPTH) -> DataFrame:
    """Each polygon (``__ring``) once per grid cell ``cx, cy`` that its bounding box touches; empty rings touch none.

    ``x0, y0, x1, y1`` bound the box in finest cells (``cell`` halved ``depth`` times).
    """
    names = ("x0", "y0", "x1", "y1")
    box = dict(zip(names, ring_bbox("__ring"), strict=True))
    b = polys.where(F.size("__ring") > 0).withColumns({f"__{n}": _cell_index(c, cell / (1 << depth)) for n, c in box.items()})
    spans = {c: F.explode(F.expr(f"sequence(shiftright(__{n}0, {depth}), shiftright(__{n}1, {depth}))")) for c, n in (("cx", "x"), ("cy", "y"))}
    return b.withColumn("cx", spans["cx"]).withColumn("cy", spans["cy"])


def quadtree(points: DataFrame, x: str, y: str, cell: float, limit: int = CELL_POINTS, depth: int = CELL_DEPTH) -> DataFrame:
    """Leaves ``level, lx, ly`` of a quadtree over the grid, with their finest cells ``fx, fy`` and ``pieces``.

    A cell of more than ``limit`` points is halved both ways until each part has
    fewer, at most ``depth`` times. Points are counted once, by finest cell; the
    tree is made from these counts. A leaf that is still too full (equal points)
    is cut into ``pieces``.
    """
    fine = points.groupBy(*[_cell_index(c, cell / (1 << depth)).alias(n) for c, n in ((x, "fx"), (y, "fy"))]).agg(F.count(F.lit(1)).alias("n"))
    fine = materialize(fine.where("fx is not null and fy is not null"), "quadtree-cells")
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    levels = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).select("fx", "fy", "n", "level", up("fx").alias("lx"), up("fy").alias("ly"))
    nodes = levels.groupBy("level", "lx", "ly").agg(F.sum("n").alias("k")).where((F.col("k") <= limit) | (F.col("level") == depth))
    # The leaf of a finest cell is its highest cell that is not too full.
    leaves = levels.join(nodes, ["level", "lx", "ly"]).groupBy("fx", "fy").agg(F.min(F.struct("level", "lx", "ly", "k")).alias("leaf"))
    return leaves.select("fx", "fy", "leaf.level", "leaf.lx", "leaf.ly", F.greatest(F.ceil(F.col("leaf.k") / limit), F.lit(1)).cast("int").alias("pieces"))


def _join_cells(polys: DataFrame, points: DataFrame, cell: float, limit: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Polygons (``__ring``) and points (``__px, __py``) with the key ``level, lx, ly, piece`` on which they meet."""
    leaves = materialize(quadtree(points, "__px", "__py", cell, limit, depth), "quadtree-leaves")
    at = {n: _cell_index(c, cell / (1 << depth)) for c, n in (("__px", "fx"), ("__py", "fy"))}
    row = F.xxhash64(*[F.col(f"`{c}`") for c in points.columns], F.monotonically_increasing_id())
    placed = points.withColumns(at).withColumn("__row", row).join(leaves, ["fx", "fy"])
    placed = placed.withColumn("piece", F.pmod("__row", F.col("pieces")).cast("int")).drop("fx", "fy", "pieces", "__row")
    whole = leaves.select("level", "lx", "ly", "pieces", *[F.expr(f"shiftright({c}, level)").alias(n) for c, n in (("lx", "cx"), ("ly", "cy"))]).distinct()
    met = polygon_cells(polys, cell, depth).join(whole, ["cx", "cy"])
    inside = [F.expr(f"l{n} between shiftright(__{n}0, {depth} - level) and shiftright(__{n}1, {depth} - level)") for n in "xy"]
    met = met.where(inside[0] & inside[1]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return met.drop("cx", "cy", "pieces", "__x0", "__y0", "__x1", "__y1"), placed


def covers_join(
    polys: DataFrame, points: DataFrame, x: str = "px", y: str = "py", cell: float = 0.1, keep_unmatched: bool = True,
    limit: int = CELL_POINTS, depth: int = CELL_DEPTH,
) -> DataFrame:
    """Polygons left-joined to every point they cover (boundary included).

    Equi join on quadtree cells of at most ``limit`` places, exact ring test
    after it, both on coordinates rounded to 12 decimals; polygons without a
    point are kept once with NULL point columns when ``keep_unmatched``. Both
    inputs are stored once; a place that several points share is tested once,
    and the points meet the polygons of their place in an equi join.
    """
    decimals = lambda c: F.round(c.cast("double"), 12)
    ring = F.transform("ring", lambda p: F.struct(decimals(p["x"]).alias("x"), decimals(p["y"]).alias("y")))
    polys = materialize(polys, "polygons")
    rounded = materialize(points.withColumns({"__px": decimals(F.col(x)), "__py": decimals(F.col(y))}), "polygon-points")
    places = rounded.select("__px", "__py").where("__px is not null and __py is not null").distinct()
    edged = materialize(polys.withColumn("__ring", ring).withColumn("__edges", ring_edges("__ring")), "polygon-edges")
    pc, pt = _join_cells(edged, materialize(places, "polygon-places"), cell, limit, depth)
    key = ["level", "lx", "ly", "piece"]
    met = pc.drop("__ring").join(pt, key).where(covers_edges("__edges", "__px", "__py")).drop(*key, "__edges")
    met = materialize(met, "polygon-places-met")  # read twice: for the points and for the polygons without one
    hits = met.join(rounded, ["__px", "__py"]).select(*polys.columns, *points.columns)
    if not keep_unmatched:
        return hits
    id_cols = [c for c in polys.columns if c != "ring"]
    missing = join_on(polys, met.select(*id_cols).distinct(), id_cols, "left_anti", null_safe=True)
    return union_rows(hits, missing)


def mercator_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    mx, my = web_mercator(lon, lat)
    return df.withColumns({"x_3857": mx, "y_3857": my})


def bbox_buffer(df: DataFrame, lon: str = "longitude", lat: str = "latitude", metres: float = 1000.0) -> DataFrame:
    """Bounding box of the points in Web Mercator, grown by ``metres`` on every side."""
    m = mercator_points(df, lon, lat)
    return m.agg(
        (F.min("x_3857") - metres).alias("xmin"),
        (F.min("y_3857") - metres).alias("ymin"),
        (F.max("x_3857") + metres).alias("xmax"),
        (F.max("y_3857") + metres).alias("ymax"),
    )


def block_crosswalk(
    checklists: DataFrame,
    old_polys: DataFrame,
    old_id: str = "pba2_block",
    block: str = "pba3_block",
    overrides: dict[str, str] | None = None,
    cell: float = 0.1,
) -> DataFrame:
    """Old polygon ↔ new block: interior point of each new block's checklist hull,
    matched to the old polygons covering it; ``overrides`` pins new block -> old id
    and drops the then-unmatched copy of that old polygon."""
    hp = hull_and_point(checklists, block)
    cw = covers_join(old_polys, hp.select(block, "px", "py"), cell=cell).select(old_id, block)
    if overrides:
        fix = None
        for nb, oid in overrides.items():
            fix = (F.when(F.col(block) == nb, F.lit(oid)) if fix is None else fix.when(F.col(block) == nb, F.lit(oid)))
        cw = cw.withColumn(old_id, fix.otherwise(F.col(old_id)))
        pinned = list(overrides.values())
        cw = cw.where(~(F.col(old_id).isin(pinned) & F.col(block).isNull()))
    return cw


def one_to_one_violations(pairs: DataFrame, left: str, right: str, drop_null: bool = True) -> DataFrame:
    """Values of ``left`` linked to more than one ``right`` (empty = 1-1 on that side)."""
    d = pairs.select(left, right).distinct()
    if drop_null:
        d = d.where(F.col(left).isNotNull())
    return d.groupBy(left).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


__all__: Sequence[str] = [
    "hull_and_point",
    "covers_join",
    "mercator_points",
    "bbox_buffer",
    "block_crosswalk",
    "one_to_one_violations",
]
