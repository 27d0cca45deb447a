"""Run tables by their ends, against sets of pixels."""

import random

from plumbline.operators import raster as R
from plumbline.operators import walls


def runs(cells):
    return sorted((p, y, x, next(z for z in range(x, 99) if (p, y, z + 1) not in cells)) for p, y, x in cells if (p, y, x - 1) not in cells)


def drawn(seed, share):
    rng = random.Random(seed)
    return {(p, y, x) for p in range(3) for y in range(14) for x in range(23) if rng.random() < share}


def frame(spark, cells):
    return spark.createDataFrame(runs(cells), "plan_id long, y long, x0 long, x1 long")


def test_difference_by_ends(spark):
    for a, b in ((drawn(1, 0.7), drawn(2, 0.3)), (drawn(3, 0.9), drawn(4, 0.8)), (drawn(5, 0.5), {(0, 0, 0)})):
        got = R.difference(frame(spark, a), frame(spark, b), ["plan_id"])
        assert got.columns == ["plan_id", "y", "x0", "x1"] and sorted(map(tuple, got.collect())) == runs(a - b)
    wide = spark.createDataFrame([(0, 0, 0, 10**9)], "plan_id long, y long, x0 long, x1 long")  # as pixels it would be a thousand million rows
    assert R.difference(wide, frame(spark, {(0, 0, 7)}), ["plan_id"]).count() == 2


def test_places_along_an_axis_are_exact(spark):
    side = [(0, 0, [{"x": 20.5, "y": 20.5}, {"x": 20.5 + n, "y": 20.5}, {"x": 20.5 + n, "y": 20.5 + n}, {"x": 20.5, "y": 20.5 + n}]) for n in range(160, 260)]
    rings = spark.createDataFrame(side, "plan_id long, floor long, ring array<struct<x: double, y: double>>")
    assert walls.samples(rings, 1.0).filter("x - floor(x) != 0.5 OR y - floor(y) != 0.5").isEmpty()
