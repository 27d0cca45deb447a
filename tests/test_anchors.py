"""Where warnings point, with what is missing or broken; legends among outlines and in drawings."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import anchors, detect, validate
from plumbline.sources import images

RING = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)]
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
POINTS = "array<struct<x: double, y: double>>"
WARNING = f"plan_id bigint, warning_id bigint, floor bigint, code string, stated {anchors.ANCHOR}, floors array<int>, names array<string>, points {POINTS}, rect {BOX}, name string"


def found(spark, warnings, outlines=(), rooms=(), labels=()):
    rows = [(1, i, w.get("floor", 0), w.get("code"), w.get("stated"), w.get("floors"), w.get("names"), w.get("points"), w.get("rect"), w.get("name")) for i, w in enumerate(warnings)]
    out = anchors.resolved(
        spark.createDataFrame(rows, WARNING), spark.createDataFrame(list(outlines), f"plan_id bigint, floor bigint, ring {POINTS}"),
        spark.createDataFrame(list(rooms), f"plan_id bigint, room_id bigint, name string, rect {BOX}"), spark.createDataFrame(list(labels), f"plan_id bigint, label_id bigint, text string, box {BOX}"),
    )
    got = {r.warning_id: (r.anchor, r.b) for r in out.withColumn("b", anchors.bounds(F.col("anchor"))).collect()}
    assert len(got) == len(warnings)
    return [got[i] for i in range(len(warnings))]


def test_own_outline_and_what_is_left_of_it(spark):
    nan = float("nan")
    broken = [(0.0, 0.0), (nan, 1.0), (1.0, float("inf")), (4.0, 4.0)]
    got = found(spark, [{"code": "unsealed"}, {"code": "unsealed", "floor": 1}, {"code": "unsealed", "floor": 2}, {"code": "unsealed", "floor": None}, {"code": None}, {"code": "no-boundary"}, {"code": "never heard of"}], [(1, 0, RING), (1, 1, broken), (1, 2, None), (2, 0, RING)])
    a, b = got[0]
    assert (a.kind, [[(p.x, p.y) for p in r] for r in a.rings]) == ("ring", [RING]) and tuple(b) == (0, 0, 10, 5)
    assert all(x == (None, None) for x in got[1:])


def test_floors_that_overlap(spark):
    other = [(x + 20, y) for x, y in RING]
    outlines = [(1, 0, RING), (1, 3, other)]
    got = found(spark, [{"code": "floors-overlap", "floors": [3, 0]}, {"code": "floors-overlap", "floors": [7, 3, None]}, {"code": "floors-overlap", "floors": [8]}, {"code": "floors-overlap"}, {"code": "floors-overlap", "floor": 5, "floors": []}], outlines)
    assert [[r[0].x for r in a.rings] if a else None for a, _ in got] == [[20, 0], [20], [0], [0], None] and tuple(got[0][1]) == (0, 0, 30, 5)


def test_labels_and_rooms(spark):
    labels = [(1, 5, "Den", (2.0, 2.0, 4.0, 4.0)), (1, 4, "Den", (0.0, 0.0, 2.0, 2.0)), (1, 3, "Den", None), (1, 9, None, (0.0, 0.0, 1.0, 1.0)), (2, 1, "Hall", (0.0, 0.0, 1.0, 1.0))]
    rooms = [(1, 2, "Den", (5.0, 9.0, 1.0, 3.0)), (1, 1, "Den", None), (1, 0, None, (0.0, 0.0, 1.0, 1.0)), (1, 7, "Flat", (0.0, 1.0, 4.0, 1.0))]
    got = found(spark, [
        {"code": "label-outside", "names": ["Hall", "Den", None, "Den"]}, {"code": "label-outside", "points": [(float("nan"), 1.0), (3.0, 4.0)], "names": ["Den"]}, {"code": "label-outside", "points": [(None, 1.0)], "names": ["Den"]}, {"code": "label-outside", "names": []},
        {"code": "room-outside", "rect": (4.0, 4.0, 2.0, 1.0), "name": "Den"}, {"code": "room-outside", "rect": (4.0, 4.0, 4.0, 1.0), "name": "Den"}, {"code": "room-outside", "name": None}, {"code": "room-outside", "name": "Flat"},
    ], labels=labels, rooms=rooms)
    points = [[(p.x, p.y) for p in a.points] if a and a.points else None for a, _ in got]
    assert points == [[(1, 1), (1, 1)], [(3, 4)], [(1, 1)], None, None, None, None, None]
    assert [(a.kind, a.x, a.y, a.width, a.height) if a and a.kind == "rect" else None for a, _ in got] == [None] * 4 + [("rect", 2, 1, 2, 3), ("rect", 1, 3, 4, 6), None, None]
    assert tuple(got[5][1]) == (1, 3, 5, 9)


def test_stated_anchor_goes_first(spark):
    stated = ("segment", [[(1.0, 2.0), (3.0, 4.0)], [(9.0, 0.0), (5.0, 5.0)]], None, None, None, None, None)
    (a, b), = found(spark, [{"code": "no-boundary", "stated": stated}], [(1, 0, RING)])
    assert a.kind == "segment" and len(a.rings) == 2 and tuple(b) == (1, 0, 9, 5)


def test_anchors_are_brought_back(spark):
    none = None
    rows = [
        (("ring", [[(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], [(1.0, 1.0), (2.0, 2.0)]], none, none, none, none, none),), (("segment", [[(1.0, 2.0)]], none, none, none, none, none),), (("point", none, [(1.0, 2.0)], none, none, none, none),),
        (("rect", none, none, 1.0, 2.0, 3.0, 4.0),), (("circle", none, none, 1.0, 2.0, 3.0, 4.0),), (None,),
    ]
    df = spark.createDataFrame(rows, f"a {anchors.ANCHOR}").select(anchors.brought_back(F.col("a"), F.lit(0.5), F.lit(0.25)).alias("a"))
    ring, segment, point, rect, circle, nothing = [r.a for r in df.collect()]
    assert [[(p.x, p.y) for p in r] for r in ring.rings] == [[(2, 8), (6, 16), (10, 24)]] and [[(p.x, p.y) for p in r] for r in segment.rings] == [[(2, 8)]]
    assert [(p.x, p.y) for p in point.points] == [(2, 8)] and (rect.x, rect.y, rect.width, rect.height) == (2, 8, 6, 16) and circle is None and nothing is None


def test_buildings(spark):
    box = lambda x, w, h: [(float(x), 0.0), (x + w, 0.0), (x + w, h), (float(x), h)]
    rows = [(1, 0, box(0, 100.0, 100.0), 0.1, None), (1, 1, box(200, 50.0, 50.0), 0.1, False), (1, 2, box(300, 50.0, 50.0), 0.1, True), (1, 3, box(400, 50.0, 50.0), 0.9, None), (1, 4, box(500, 30.0, 30.0), 0.9, True), (1, 5, box(600, 90.0, 90.0), 0.1, None),
            (2, 7, None, 0.1, None), (4, 1, [(0.0, 0.0)] * 3, 0.1, None), (3, 1, box(0, 9.0, 9.0), None, None), (3, 2, box(0, 9.0, 9.0), 0.0, None)]
    df = spark.createDataFrame(rows, f"plan_id bigint, floor bigint, ring {POINTS}, structural double, held boolean")
    got = {(r.plan_id, r.floor): (r.building, r.rejected) for r in validate.buildings(df).collect()}
    assert got == {(1, 0): (True, 2), (1, 1): (False, 2), (1, 2): (True, 2), (1, 3): (True, 2), (1, 4): (False, 2), (1, 5): (True, 2), (2, 7): (True, 0), (4, 1): (True, 0), (3, 1): (True, 0), (3, 2): (True, 0)}
    assert validate.buildings(df.limit(0)).count() == 0


def test_a_thinly_drawn_legend_is_no_floor(spark):
    house, legend = np.array([(30, 30), (330, 30), (330, 250), (30, 250)], float), np.array([(400, 40), (540, 40), (540, 170), (400, 170)], float)
    page = images.drawing([house], 600, 300, 8)
    thin = images.drawing([legend], 600, 300, 1)
    both = np.minimum(page, thin)
    thick = images.drawing([house, legend], 600, 300, 8)
    df = spark.createDataFrame([(k, 600, 300, bytearray(p.tobytes())) for k, p in ((1, both), (2, thick), (3, both))], "plan_id bigint, width int, height int, data binary")
    inside = spark.createDataFrame([(3, 470.0, 100.0)], "plan_id bigint, x double, y double")
    got = detect.floors(df, inside).orderBy("plan_id", "floor").collect()
    # one drawn with walls is a building, and so is one that a label says is one
    assert [(r.plan_id, r.floor, r.rejected) for r in got] == [(1, 0, 1), (2, 0, 0), (2, 1, 0), (3, 0, 0), (3, 1, 0)]
