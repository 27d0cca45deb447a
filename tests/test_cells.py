"""One crowded plan: joins by cells of a grid give what every pair gives, and no task has the whole plan."""

import random

from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import editing, spatial

RNG = random.Random(5)
RING = "array<struct<x: double, y: double>>"


def rectangle(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def by_cells(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    return joins and all("_cx" in line and "_cy" in line for line in joins)


def shapes(n):
    # some on the lines between cells, some below zero, some over many cells
    return [(i, rectangle(RNG.choice([1024.0, RNG.uniform(-2000, 6000)]), RNG.choice([-1024.0, RNG.uniform(-2000, 6000)]), RNG.choice([40.0, 300.0, 2500.0]), RNG.choice([40.0, 300.0, 2500.0]))) for i in range(n)]


def test_nearest_wall(spark):
    points = [(1, i, RNG.uniform(-500, 5000), *sorted((RNG.uniform(-500, 5000), RNG.uniform(-500, 5000)))) for i in range(150)] + [(1, 900, 1024.0, 0.0, 1024.0), (1, 901, None, 0.0, 9.0), (1, 902, 5.0, 9.0, 1.0), (1, 903, float("inf"), 0.0, 1.0)]
    walls = [(1, i, p, p + 8, *sorted((RNG.uniform(-500, 5000), RNG.uniform(-500, 5000)))) for i in range(150) for p in [RNG.uniform(-500, 5000)]] + [(1, 900, 1024.0, 1032.0, 1024.0, 2000.0), (1, 901, 1018.0, 1026.0, 100.0, 200.0)]
    got = spatial.nearest_wall(spark.createDataFrame(points, "plan_id bigint, point_id bigint, pos double, a double, b double"), spark.createDataFrame(walls, "plan_id bigint, wall_id bigint, face_lo double, face_hi double, lo double, hi double"), 12.0)
    want = {}
    for _, p, pos, a, b in points:
        near = [(abs(pos - f), -(min(b, hi) - max(a, lo)), w, f) for _, w, f0, f1, lo, hi in walls for f in (f0, f1) if pos is not None and min(b, hi) > max(a, lo) and abs(pos - f) <= 12]
        if near:
            want[p] = min(near)[2:]
    assert {r.point_id: (r.wall_id, r.face) for r in got.collect()} == want and len(want) > 40
    assert by_cells(got)


def test_target_outlines(spark):
    outlines = spark.createDataFrame([(1, i, r, i % 7 == 0) for i, r in shapes(120)], f"plan_id bigint, trace_id bigint, ring {RING}, active boolean")
    holes = spark.createDataFrame([(1, i, r) for i, r in shapes(200)] + [(1, 900, []), (1, 901, None)], f"plan_id bigint, ring_id bigint, hole {RING}")
    pair = holes.withColumn("c", geom.centroid(F.col("hole"))).join(outlines, "plan_id").filter(geom.in_ring(F.col("c"), F.col("ring")))
    want = pair.groupBy("ring_id").agg(F.min(F.struct((~F.col("active")).alias("a"), geom.ring_area(F.col("ring")).alias("s"), "trace_id")).alias("b")).collect()
    got = editing.target_outline(outlines, holes)
    assert {r.ring_id: r.trace_id for r in got.collect()} == {r.ring_id: r.b.trace_id for r in want} and len(want) > 60
    assert by_cells(got)


def test_classified_outlines(spark):
    outlines = [*shapes(80), (500, rectangle(20000.0, 20000.0, 300.0, 300.0))]
    kinds = ["gla", "garage", "porch"]
    marks = [(i, kinds[i % 3], RNG.uniform(-2200, 6500), RNG.uniform(-2200, 6500), 60.0, 12.0) for i in range(300)] + [(900, "garage", 1024.0, 1024.0, 0.0, 0.0), (901, "porch", 20050.0, 19950.0, 60.0, 12.0)]
    got = spatial.classify(spark.createDataFrame([(1, i, r) for i, r in outlines], f"plan_id bigint, trace_id bigint, ring {RING}"), spark.createDataFrame([(1, *m) for m in marks], "plan_id bigint, label_id bigint, type string, x double, y double, w double, h double"))
    votes = {}
    for _, kind, x, y, w, h in marks:
        cx, cy, inside, near = x + w / 2, y + h / 2, [], []
        for i, r in outlines:
            (x0, y0), (x1, y1) = r[0], r[2]
            if x0 <= cx < x1 and y0 <= cy < y1:
                inside.append(((x1 - x0) * (y1 - y0), i))
            pad = 0.1 * (x1 - x0)
            if x0 - pad <= cx <= x1 + pad and max(y0 - (y + h), y - y1, 0) <= 6 * max(h, 1):
                near.append(i)
        held = bool(inside)
        trace = min(inside)[1] if inside else near[0] if len(near) == 1 else None
        if trace is not None:
            votes.setdefault((trace, held), []).append(kind)
    want = {}
    for trace in {t for t, _ in votes}:
        held = (trace, True) in votes
        said = votes[trace, held]
        top = [k for k in kinds if said.count(k) == max(map(said.count, kinds))]
        if len(top) == 1:
            want[trace] = (top[0], "inside" if held else "title")
    assert {r.trace_id: (r.type, r.evidence) for r in got.collect()} == want and {e for _, e in want.values()} == {"inside", "title"}
    assert by_cells(got)
