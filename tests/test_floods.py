"""Floods, complements and retracing over run tables against pixels."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import floods, retrace
from plumbline.operators import kernels as K
from plumbline.operators import raster as R
from plumbline.sources.tables import Workspace

PLAN = ["plan_id"]


def table(spark, masks):
    rows = [(p, int(y), int(x)) for p, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return R.islands(spark.createDataFrame(rows, "plan_id long, y long, x long"), ["plan_id", "y"], "x")


def pixels(runs):
    return {(r.plan_id, r.y, x) for r in runs.select("plan_id", "y", "x0", "x1").collect() for x in range(r.x0, r.x1 + 1)}


def of(masks):
    return {(p, int(y), int(x)) for p, m in enumerate(masks) for y, x in zip(*np.nonzero(m))}


def flood(region, seeds):
    seen, todo = np.zeros_like(region), deque((y, x) for y, x in zip(*np.nonzero(seeds & region)))
    for y, x in todo:
        seen[y, x] = True
    while todo:
        y, x = todo.popleft()
        for b, a in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= b < region.shape[0] and 0 <= a < region.shape[1] and region[b, a] and not seen[b, a]:
                seen[b, a] = True
                todo.append((b, a))
    return seen


def noise(seed, share=0.5, shape=(24, 31)):
    return np.random.default_rng(seed).random(shape) < share


def blobs(seed, shape=(40, 60)):
    r, m = np.random.default_rng(seed), np.zeros(shape, bool)
    for _ in range(14):
        y, x, h, w = r.integers(0, shape[0]), r.integers(0, shape[1]), r.integers(1, 14), r.integers(1, 20)
        m[y : y + h, x : x + w] = True
    return m


def test_complement_enclosed_closed(spark):
    masks = [noise(1, 0.3), noise(2, 0.5), blobs(3), blobs(4)]
    ink, work = table(spark, masks), Workspace(spark, "t")
    box = spark.createDataFrame([(p, 0, 0, m.shape[1] - 1, m.shape[0] - 1) for p, m in enumerate(masks)], "plan_id long, bx0 long, by0 long, bx1 long, by1 long")
    assert pixels(floods.complement(ink, PLAN, box)) == of([~m for m in masks])
    full = [m | ~flood(~np.pad(m, 1), np.pad(np.zeros_like(m), 1, constant_values=True))[1:-1, 1:-1] for m in masks]
    assert pixels(floods.enclosed(ink, PLAN, work)) == of(full)
    for r in (1, 3):
        wide = [np.pad(m, 2 * r + 1) for m in masks]
        want = [~K.dilate(~K.dilate(m, r), r) for m in wide]
        cut = [m[2 * r + 1 : -2 * r - 1, 2 * r + 1 : -2 * r - 1] for m in want]
        assert pixels(floods.closed(ink, PLAN, F.lit(r))) == of(cut)
    part = floods.parts(ink, PLAN, work, "p-")
    assert part.select("plan_id", "root").distinct().groupBy("plan_id").count().orderBy("plan_id").select("count").collect() == [(len(K.label(m)[1]),) for m in masks]


@pytest.mark.parametrize("vertical", [False, True])
def test_structural_ink_by_flood(spark, vertical):
    masks = [blobs(k) for k in range(5)] + [noise(9, 0.9, (30, 30)), np.zeros((12, 12), bool)]
    size = spark.createDataFrame([(p, m.shape[1], m.shape[0]) for p, m in enumerate(masks)], "plan_id long, width long, height long")
    thick, gone = 5, []
    for m in masks:
        filled = K.long_runs(m, thick) & K.long_runs(m, thick, "v")
        rim = np.zeros_like(m)
        if vertical:
            rim[:, [0, -1]] = True
        else:
            rim[[0, -1]] = True
        gone.append(flood(filled, rim))
    ink, work = table(spark, masks), Workspace(spark, "t")
    assert pixels(floods.structural_ink(ink, PLAN, size, work, vertical, thick)) == of(gone)
    assert pixels(floods.without_structure(ink, PLAN, size, work, vertical, thick)) == of([m & ~g for m, g in zip(masks, gone)])


def test_a_flood_goes_round_corners(spark):
    m = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):  # a spiral of one pixel
        m[k, k : 21 - k] = m[k : 21 - k, 20 - k] = m[20 - k, k : 21 - k] = True
        m[k + 2 : 21 - k, k] = True
        m[k + 2, k : k + 3] = True
    seed = np.zeros_like(m)
    seed[0, 0] = True
    got = floods.flooded(table(spark, [seed]), table(spark, [m]), PLAN, Workspace(spark, "t"))
    assert pixels(got) == of([flood(m, seed)])


def test_only_open_plans_are_in_a_round(spark):
    """Kinds of plans as in retraced_plans, one of each, and one without places: what each round tries is told by the log."""
    bar = lambda p, net, x0, y0, x1, y1: [(p, net, y, x0, x1) for y in range(y0, y1 + 1)]
    ring = lambda p, net, x, w, h: bar(p, net, x, 18, x + 4, 22 + h) + bar(p, net, x + 5, 18, x + w + 4, 22) + bar(p, net, x + 5, 18 + h, x + w + 4, 22 + h) + bar(p, net, x + w, 23, x + w + 4, 17 + h)
    rows = ring(0, 0, 18, 160, 120) + ring(4, 0, 18, 160, 120)
    rows += bar(1, 0, 18, 18, 22, 142) + bar(1, 0, 23, 18, 162, 22) + bar(1, 1, 178, 18, 182, 142) + bar(1, 1, 38, 138, 177, 142)
    rows += ring(2, 0, 18, 160, 120) + ring(2, 1, 243, 160, 120) + bar(2, None, 192, 18, 232, 22)
    rows += bar(3, 0, 18, 18, 22, 142) + bar(3, 0, 23, 18, 182, 22) + bar(3, 0, 23, 138, 182, 142) + bar(3, 0, 178, 23, 182, 92)
    nets = spark.createDataFrame(rows, "plan_id long, net long, y long, x0 long, x1 long")
    points = spark.createDataFrame([(p, 0, 100, 80) for p in range(4)] + [(2, 1, 212, 80)], "plan_id long, point_id long, x long, y long")
    rooms = spark.createDataFrame([(0, 9, 30, 30, 150, 120)], "plan_id long, rect_id long, x0 long, y0 long, x1 long, y1 long")
    state, log, prints = retrace.retrace(nets, points, rooms, 5, 500, Workspace(spark, "t"))
    got = {r.plan_id: (r.how, r.tried, r.before, r.held, r.total) for r in state.collect()}
    assert got == {0: ("base", 0, 2, 2, 2), 1: ("join", 1, 0, 1, 1), 2: ("base", 1, 1, 1, 2), 3: ("escalate", 1, 0, 1, 1), 4: ("base", 0, 0, 0, 0)}
    assert {(r.round, r.how, r.plan_id, r.accepted) for r in log.collect()} == {*((0, "base", p, True) for p in range(5)), (1, "join", 1, True), (1, "escalate", 2, False), (1, "escalate", 3, True)}
    area = {r.plan_id: r.n for r in prints.groupBy("plan_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).collect()}
    assert area == {p: 165 * 125 * (2 if p == 2 else 1) for p in range(5)}
