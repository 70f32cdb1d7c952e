"""Planar geometry as column expressions.

A point is two double columns; a polygon is one ring ``ARRAY<STRUCT<x,y>>``
(closed or open). Predicates use Spark's higher-order functions over the ring,
so they stay JVM-side.

Coordinates mean what they say in decimal, to 12 places: a point is on an edge
if it is on it in decimal arithmetic, although the nearest doubles may not be.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockwise.functions.semantics import col

# Fixed value: spherical-Mercator earth radius in metres (EPSG:3857).
EARTH_RADIUS_M = 6378137.0


# Relative error of an orientation in doubles, with room for
# coordinates that are themselves rounded; decimal digits of a coordinate.
ORIENTATION_ERROR = 2.0**-50
DECIMAL = "decimal(16,12)"


def _closed(ring: Column) -> Column:
    """Ring with its first point repeated at the end; a one-point ring becomes one zero-length edge."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return (
        F.when(F.size(ring) == 1, F.concat(ring, ring))
        .when((first.x == last.x) & (first.y == last.y), ring)
        .otherwise(F.concat(ring, F.array(first)))
    )


def orientation(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Sign of the turn a -> b -> (x, y): 1 left, -1 right, 0 straight.

    A determinant in doubles decides where it exceeds its error bound (rounding
    of the coordinates included), decimal arithmetic everywhere else.
    """
    left, right = (b.x - a.x) * (y - a.y), (b.y - a.y) * (x - a.x)
    reach = F.abs(b.x) + F.abs(a.x) + F.abs(x), F.abs(b.y) + F.abs(a.y) + F.abs(y)
    bound = reach[0] * reach[1] * ORIENTATION_ERROR
    d = lambda c: c.cast(DECIMAL)
    exact = (d(b.x) - d(a.x)) * (d(y) - d(a.y)) - (d(b.y) - d(a.y)) * (d(x) - d(a.x))
    return F.when(F.abs(left - right) > bound, F.signum(left - right)).otherwise(F.signum(exact.cast("double"))).cast("int")


#: Beyond this distance two coordinates differ in their 12 decimals, however they were rounded.
_APART = 1e-11


def ring_edges(ring: str | Column) -> Column:
    """Edges ``ARRAY<STRUCT<a,b>>`` of a ring; none for an empty or missing ring."""
    ring = col(ring)
    edges = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(ring) > 0, F.element_at(F.transform(F.array(_closed(ring)), edges), 1))


def covers(ring: str | Column, px: str | Column, py: str | Column) -> Column:
    """Polygon covers point: inside by even-odd ray cast, or on the boundary; an empty or missing ring covers nothing."""
    return covers_edges(ring_edges(ring), px, py)


def covers_edges(edges: str | Column, px: str | Column, py: str | Column) -> Column:
    """``covers`` on the edges of a ring, which a join makes once per polygon.

    One pass over the edges. The orientation decides only for a point next to a
    slanted edge: on a level or upright edge, and beside the edge's box,
    comparisons say the same.
    """
    x, y = col(px).cast("double"), col(py).cast("double")

    def step(met, e):
        """2 once the point is on an edge, else whether a ray to the right has crossed an odd number of edges."""
        a, b = e["a"], e["b"]
        turn = orientation(a, b, x, y)
        lo, hi = F.least(a.x, b.x), F.greatest(a.x, b.x)
        within = x.between(lo, hi) & y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))
        straddles = (a.y > y) != (b.y > y)
        beside = F.when(x > hi + _APART, False).when(x < lo - _APART, True)
        crosses = F.coalesce(beside, ((turn > 0) == (b.y > a.y)) & (turn != 0))
        on_edge = within & ((a.x == b.x) | (a.y == b.y) | (turn == 0))
        return F.when(met == 2, 2).when(on_edge, 2).when(straddles & crosses, 1 - met).otherwise(met)

    return F.coalesce(F.aggregate(col(edges), F.lit(0), step) > 0, F.lit(False))


def ring_bbox(ring: str | Column) -> tuple[Column, Column, Column, Column]:
    r = col(ring)
    xs = F.transform(r, lambda p: p.x)
    ys = F.transform(r, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def web_mercator(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees -> EPSG:3857 metres."""
    lon, lat = col(lon).cast("double"), col(lat).cast("double")
    x = F.radians(lon) * EARTH_RADIUS_M
    y = F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS_M
    return x, y
