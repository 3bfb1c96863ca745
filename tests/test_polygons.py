"""Tiles of shapes with parts and holes against exact fractions."""

import random
from fractions import Fraction

from grovespark.operators import spatial

SHAPES = "stand_id long, species_code string, rings array<array<struct<x:double,y:double>>>"


def meets(edges, ix, iy):
    """Whether a closed unit box meets an edge or has its middle inside."""
    crossings = 0
    for (ax, ay), (bx, by) in edges:
        t0, t1 = Fraction(0), Fraction(1)
        for a, b, lo in ((ax, bx, ix), (ay, by, iy)):
            if a == b:
                if not lo <= a <= lo + 1:
                    t0, t1 = Fraction(1), Fraction(0)
                continue
            s, e = sorted(((lo - a) / (b - a), (lo + 1 - a) / (b - a)))
            t0, t1 = max(t0, s), min(t1, e)
        if t0 <= t1:
            return True
        my = iy + Fraction(1, 2)
        if (ay <= my) != (by <= my) and ax + (my - ay) / (by - ay) * (bx - ax) > ix + Fraction(1, 2):
            crossings += 1
    return crossings % 2 == 1


def test_tiles_of_shapes(spark):
    pick = random.Random(6)
    spot = lambda lo, hi: (pick.randint(lo * 8, hi * 8) / 8, pick.randint(lo * 8, hi * 8) / 8)  # noqa: E731  eighths are exact, and often on borders
    shapes = {i: [[spot(-2, 12) for _ in range(pick.randint(3, 8))] for _ in range(pick.randint(1, 3))] for i in range(40)}
    shapes[100] = [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0), (1.0, 1.0)], [(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0)]]  # a hole; the first ring is closed
    shapes[101] = [[(-5.0, -5.0), (20.0, -5.0), (20.0, 20.0), (-5.0, 20.0)]]  # holds all
    shapes[102] = [[(2.5, 2.5)], []]
    shapes[103] = [[(30.0, 30.0), (31.0, 30.0), (31.0, 32.0)]]
    df = spark.createDataFrame([(i, "SO", [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, rings in shapes.items()] + [(200, "SO", None)], SHAPES)
    grid = spark.createDataFrame([(0.0, 0.0, 10, 9)], "ox double, oy double, nx int, ny int")
    got = {tuple(r) for r in spatial.polygon_tiles(df, grid, 1.0).collect()}
    want = set()
    for i, rings in shapes.items():
        exact = [[(Fraction(x), Fraction(y)) for x, y in r] for r in rings]
        edges = [(a, b) for r in exact for a, b in zip(r, r[1:] + r[:1])]
        want |= {(i, ix, iy) for ix in range(10) for iy in range(9) if meets(edges, ix, iy)}
    assert got == want
    assert (100, 4, 4) not in got and (100, 2, 2) in got and len([t for t in got if t[0] == 101]) == 90
    assert spatial.polygon_tiles(df.limit(0), grid, 1.0).count() == 0
