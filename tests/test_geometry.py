"""Robust orientation, hulls by slices, the quadtree join on skewed points."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from blockwise.functions.geo import covers
from blockwise.plans.spatial import block_crosswalk, covers_join, hull_and_point, quadtree

RING = "pid string, ring array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def exact_covers(points, x, y):
    """Even-odd rule and boundary in fractions of the decimals that the coordinates are written as."""
    p = [(Fraction(str(a)), Fraction(str(b))) for a, b in points]
    x, y = Fraction(str(x)), Fraction(str(y))
    inside = False
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
        turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if turn == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (turn > 0) == (by > ay):
            inside = not inside
    return inside


def test_covers_on_slanted_edges_and_next_to_them(spark):
    shapes = {
        "triangle": [(0.0, 0.0), (0.3, 0.1), (0.0, 0.7)],
        "thin": [(-80.1, 40.0), (-79.8, 40.3), (-79.8, 40.300001)],
        "star": [(0.1, 0.1), (0.7, 0.4), (0.1, 0.7), (0.5, 0.0), (0.5, 0.8)],
        "point": [(0.1, 0.1)],
        "segment": [(0.1, 0.1), (0.7, 0.7)],
    }
    rng = random.Random(2)
    points = [(round(rng.uniform(-0.1, 0.9), k), round(rng.uniform(-0.1, 0.9), k)) for k in (1, 2) for _ in range(150)]
    for (ax, ay), (bx, by) in [(s[i], s[(i + 1) % len(s)]) for s in shapes.values() for i in range(len(s))]:
        for t in (0, 0.25, 1 / 3, 0.5):
            x, y = round(ax + t * (bx - ax), 6), round(ay + t * (by - ay), 6)
            points += [(x, y), (round(x + 1e-9, 12), y), (x, round(y - 1e-11, 12))]
    polys = spark.createDataFrame([(k, ring(*v)) for k, v in shapes.items()] + [("empty", []), ("none", None)], RING)
    pts = spark.createDataFrame(points, "px double, py double").distinct()
    got = {(r.pid, r.px, r.py) for r in polys.join(pts, F.lit(True)).where(covers("ring", "px", "py")).collect()}
    want = {(k, x, y) for k, v in shapes.items() for x, y in set(points) if exact_covers(v, x, y)}
    assert got == want and len(want) > 80


def hull(points):
    """Monotone chain in fractions."""
    pts = sorted({(Fraction(str(x)), Fraction(str(y))) for x, y in points})
    if len(pts) <= 2:
        return [(float(x), float(y)) for x, y in pts]

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return [(float(x), float(y)) for x, y in chain(pts) + chain(pts[::-1])]


@pytest.mark.parametrize("slice_points", [10_000, 7])
def test_hull_equals_exact_chain(spark, slice_points):
    import math

    rng = random.Random(4)
    groups = {
        "grid": [(round(0.1 * i, 1), round(0.1 * j, 1)) for i in range(12) for j in range(9)],
        "cloud": [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(800)],
        "circle": [(round(math.cos(k), 9), round(math.sin(k), 9)) for k in range(300)],
        "line": [(round(0.1 * i, 1), round(0.3 * i, 1)) for i in range(30)],
        "pair": [(1.0, 2.0), (0.5, 2.0), (1.0, 2.0)],
        "one": [(3.5, 1.5)],
    }
    rows = [(g, x, y) for g, pts in groups.items() for x, y in pts] + [(None, 1.0, 1.0), ("one", None, 2.0)]
    out = hull_and_point(spark.createDataFrame(rows, "g string, longitude double, latitude double"), "g", slice_points=slice_points)
    got = {r.g: ([(p.x, p.y) for p in r.ring], r.n_points, r.px, r.py) for r in out.collect()}
    assert got.keys() == groups.keys()
    for g, pts in groups.items():
        vertices, n, px, py = got[g]
        want = hull(pts)
        assert vertices == (want + want[:1] if len(want) > 2 else want), g
        assert n == len(set(pts)) and exact_covers(want, px, py), g


def test_no_cell_of_the_polygon_join_is_crowded(spark):
    """40 % of the points lie in one cell, a tenth of them at one place; tasks stay bounded and nothing is lost."""
    rng = random.Random(6)
    near = [(round(0.05 + rng.random() * 1e-3, 6), round(0.05 + rng.random() * 1e-3, 6)) for _ in range(1500)]
    points = near + [(0.0505, 0.0505)] * 200 + [(round(rng.uniform(0, 2), 4), round(rng.uniform(0, 2), 4)) for _ in range(2500)]
    shapes = {"hot": [(0.0499, 0.0499), (0.0512, 0.05), (0.0505, 0.0514)], "wide": [(0.0, 0.0), (2.0, 0.1), (1.1, 1.9)], "far": [(5, 5), (6, 5), (6, 6)]}
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id long, px double, py double")
    polys = spark.createDataFrame([(k, ring(*v)) for k, v in shapes.items()], RING)
    for limit, depth in ((100, 12), (100, 3)):
        leaves = quadtree(pts, "px", "py", 0.1, limit, depth)
        per = pts.withColumns({n: F.floor(F.col(c) / (0.1 / (1 << depth))).cast("long") for n, c in (("fx", "px"), ("fy", "py"))}).join(leaves, ["fx", "fy"])
        crowd = per.groupBy("level", "lx", "ly").agg(F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces")).collect()
        assert sum(r.n for r in crowd) == len(points) and max(r.n / r.pieces for r in crowd) <= limit
        assert max(r.level for r in crowd) > 0 and min(r.level for r in crowd) == 0
        got = sorted((r.pid, -1 if r.id is None else r.id) for r in covers_join(polys, pts, limit=limit, depth=depth).collect())
        want = sorted([(k, i) for k in ("hot", "wide") for i, (x, y) in enumerate(points) if exact_covers(shapes[k], x, y)] + [("far", -1)])
        assert got == want


def test_crosswalk_override_replaces_the_unmatched_copy(spark):  # G9
    squares = [(f"P{i}", ring((i, 0), (i + 1, 0), (i + 1, 1), (i, 1))) for i in range(3)]
    polys = spark.createDataFrame(squares, "pba2_block string, ring array<struct<x:double,y:double>>")
    checklists = spark.createDataFrame([("A", 0.5, 0.5), ("B", 1.5, 0.5)], "pba3_block string, longitude double, latitude double")
    plain = {(r.pba2_block, r.pba3_block) for r in block_crosswalk(checklists, polys, cell=1.0).collect()}
    assert plain == {("P0", "A"), ("P1", "B"), ("P2", None)}
    pinned = {(r.pba2_block, r.pba3_block) for r in block_crosswalk(checklists, polys, overrides={"B": "P2"}, cell=1.0).collect()}
    assert pinned == {("P0", "A"), ("P2", "B")}
