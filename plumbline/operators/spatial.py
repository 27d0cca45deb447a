"""Joins of outlines, labels, rooms and walls. All are equi-joins on the plan first; what is near, inside or overlapping is the residual. Boxes meet by the cells
of a grid, too, so that a plan with very many is not every box against every other, and not one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geom, labels

TITLE_BAND = 6.0  # fixed value: heights of a label within which it can be an outline's title
CELL = 256.0  # pixels of a grid cell
FARTHEST = 1e12  # pixels; boxes farther out, and those with a side that is no number, meet nothing
WIDE = 1024.0  # the same where whole outlines and walls are one side


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a projection alone would be written out again in each expression that reads it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _in_cells(df: DataFrame, cell: float) -> DataFrame:
    df = once(df, "box", F.col("box"))
    at = lambda k: F.floor(F.col("box")[k] / cell).cast("bigint")
    for k in ("x0", "y0", "x1", "y1"):
        df = df.filter(F.abs(F.col("box")[k]) < FARTHEST)
    return df.withColumns({"_x0": at("x0"), "_y0": at("y0")}).withColumn("_cx", F.explode(F.sequence("_x0", at("x1")))).withColumn("_cy", F.explode(F.sequence("_y0", at("y1"))))


def meeting(a: DataFrame, b: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of rows, as a and b, of one plan whose boxes (column box) meet; each pair once, in the first cell that both are in."""
    first = lambda k: F.greatest(F.col(f"a._{k}0"), F.col(f"b._{k}0")) == F.col(f"a._c{k}")
    on = (F.col("a.plan_id") == F.col("b.plan_id")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    return _in_cells(a, cell).alias("a").join(_in_cells(b, cell).alias("b"), on).filter(first("x") & first("y") & geom.boxes_meet(F.col("a.box"), F.col("b.box")))


def center(x: Column, y: Column, w: Column, h: Column) -> Column:
    return geom.point(x + w / 2, y + h / 2)


def title_gap(b: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Vertical distance of a label from a box that it stands above or below; infinite where it stands aside, more than a tenth of the width."""
    pad, c = (b["x1"] - b["x0"]) * 0.1, x + w / 2
    return F.when((c < b["x0"] - pad) | (c > b["x1"] + pad), F.lit(float("inf"))).otherwise(F.greatest(b["y0"] - (y + h), y - b["y1"], F.lit(0.0)))


def classify(outlines: DataFrame, marks: DataFrame) -> DataFrame:
    """(plan_id, trace_id, type, evidence): what the labels say an outline is.

    A label belongs to the smallest outline that holds its centre. One that none holds is the title of an outline if it is the only one within TITLE_BAND
    heights. Labels inside outrank titles; the type of most labels wins and a draw says nothing. outlines: plan_id, trace_id, ring. marks: plan_id,
    label_id, type, x, y, w, h.
    """
    shape = once(outlines.filter(F.size("ring") >= 3).select("plan_id", "trace_id", "ring"), "box", geom.bounds(F.col("ring")))
    # a label meets an outline, if its centre's column does, up to the heights that make it a title, within the outline's box and the pad beside it
    b, reach, mid = F.col("box"), TITLE_BAND * F.greatest(F.col("h"), F.lit(1.0)), F.col("x") + F.col("w") / 2
    pad = (b["x1"] - b["x0"]) * 0.1
    band = geom.box(mid, F.least(F.col("y"), F.col("y") + F.col("h")) - reach, mid, F.greatest(F.col("y"), F.col("y") + F.col("h")) + reach)
    wide = shape.withColumn("around", b).withColumn("box", geom.box(b["x0"] - pad, b["y0"], b["x1"] + pad, b["y1"]))
    near = meeting(marks.filter(F.col("type").isNotNull()).withColumn("box", band), wide, WIDE)
    pair = near.select("a.plan_id", "a.label_id", "a.type", "a.x", "a.y", "a.w", "a.h", "b.trace_id", "b.ring", F.col("b.around").alias("box"))
    c = center(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    within = (c["x"].between(F.col("box.x0"), F.col("box.x1"))) & (c["y"].between(F.col("box.y0"), F.col("box.y1")))
    pair = pair.withColumns({"inside": F.when(within, geom.in_ring(c, F.col("ring"))).otherwise(F.lit(False)), "size": geom.box_area(F.col("box")), "near": title_gap(F.col("box"), F.col("x"), F.col("y"), F.col("w"), F.col("h")) <= TITLE_BAND * F.greatest(F.col("h"), F.lit(1.0))}).drop("ring", "box")
    label = pair.groupBy("plan_id", "label_id", "type").agg(
        F.min(F.when(F.col("inside"), F.struct("size", "trace_id"))).alias("host"), F.sum(F.col("near").cast("int")).alias("n"), F.min(F.when(F.col("near"), F.col("trace_id"))).alias("title")
    )
    said = label.select("plan_id", labels.normal_type(F.col("type")).alias("type"), F.col("host").isNotNull().alias("held"), F.coalesce("host.trace_id", F.when(F.col("n") == 1, F.col("title"))).alias("trace_id"))
    votes = said.dropna(subset=["trace_id"]).groupBy("plan_id", "trace_id", "held", "type").agg(F.count("*").alias("n"))
    whole = W.partitionBy("plan_id", "trace_id")
    votes = votes.withColumn("best", F.max("held").over(whole)).filter(F.col("held") == F.col("best"))
    top = votes.withColumns({"top": F.max("n").over(whole)}).filter("n = top").withColumn("ties", F.count("*").over(whole)).filter("ties = 1")
    return top.select("plan_id", "trace_id", "type", F.when(F.col("held"), F.lit("inside")).otherwise(F.lit("title")).alias("evidence"))


def double_counted(outlines: DataFrame, share: float = 0.9) -> DataFrame:
    """(plan_id, inner_id, outer_id): outlines of other types that lie with so many of their corners in a living-area outline, the first by id.

    outlines: plan_id, trace_id, type, ring.
    """
    kind = labels.normal_type(F.col("type"))
    boxed = outlines.filter(F.size("ring") > 0).select("plan_id", "trace_id", "ring", (kind == "gla").alias("living"), geom.bounds(F.col("ring")).alias("box"))
    pair = meeting(boxed.filter("NOT living"), boxed.filter("living")).filter(geom.share_inside(F.col("a.ring"), F.col("b.ring")) >= share)
    return pair.groupBy(F.col("a.plan_id").alias("plan_id"), F.col("a.trace_id").alias("inner_id")).agg(F.min("b.trace_id").alias("outer_id"))


def non_living_rooms(rooms: DataFrame, marks: DataFrame) -> DataFrame:
    """rooms that count as outside the living area: by a word of their own label, or by any label's box that overlaps theirs.

    rooms: plan_id, room_id, name, x0, y0, x1, y1. marks: plan_id, x, y, w, h.
    """
    over = (F.col("r.plan_id") == F.col("m.plan_id")) & (F.col("r.x0") < F.col("m.x") + F.col("m.w")) & (F.col("m.x") < F.col("r.x1")) & (F.col("r.y0") < F.col("m.y") + F.col("m.h")) & (F.col("m.y") < F.col("r.y1"))
    word = labels.exterior_feature(F.col("name")).isNotNull()
    return rooms.filter(word).unionByName(rooms.filter(~F.coalesce(word, F.lit(False))).alias("r").join(marks.alias("m"), over, "left_semi"))


def nearest_wall(points: DataFrame, walls: DataFrame, tolerance: float) -> DataFrame:
    """(plan_id, point_id, wall_id, face): the wall face nearest to pos within a tolerance, among walls that share some of [a, b]; of equal ones the longer share, then the id.

    points: plan_id, point_id, pos, a, b. walls: plan_id, wall_id, face_lo, face_hi, lo, hi.
    """
    face = walls.select("plan_id", "wall_id", "lo", "hi", F.explode(F.array("face_lo", "face_hi")).alias("face")).withColumn("box", geom.box(F.col("face"), F.col("lo"), F.col("face"), F.col("hi")))
    spot = points.withColumn("box", geom.box(F.col("pos") - tolerance, F.col("a"), F.col("pos") + tolerance, F.col("b")))
    near = meeting(spot, face, WIDE).select("a.plan_id", "a.point_id", "a.pos", "b.wall_id", "b.face", (F.least("a.b", "b.hi") - F.greatest("a.a", "b.lo")).alias("shared"))
    both = near.filter("shared > 0")
    gap = F.abs(F.col("pos") - F.col("face"))
    best = both.withColumn("gap", gap).filter(F.col("gap") <= tolerance).groupBy("plan_id", "point_id").agg(F.min(F.struct("gap", (-F.col("shared")).alias("s"), "wall_id", "face")).alias("b"))
    return best.select("plan_id", "point_id", "b.wall_id", "b.face")


def neighbours(rings: DataFrame) -> DataFrame:
    """(..., i, x, y, prev_x, prev_y, next_x, next_y): each vertex with the one before and after, around the ring. rings: plan_id, trace_id, ring."""
    v = rings.select("plan_id", "trace_id", F.size("ring").alias("n"), "ring", F.posexplode("ring").alias("i", "p"))
    at = lambda k: F.get("ring", k)
    before, after = at((F.col("i") - 1 + F.col("n")) % F.col("n")), at((F.col("i") + 1) % F.col("n"))
    return v.select("plan_id", "trace_id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y", before["x"].alias("prev_x"), before["y"].alias("prev_y"), after["x"].alias("next_x"), after["y"].alias("next_y"))


def erased(vertices: DataFrame, path: DataFrame, radius: float, least: int = 3) -> DataFrame:
    """The vertices left after rubbing along a path: those within a radius go, the nearest first, but so many stay.

    vertices: plan_id, i, x, y. path: plan_id, ord, x, y (its points; segments join neighbours, one point is a dot).
    """
    nxt = F.lead(F.struct("x", "y")).over(W.partitionBy("plan_id").orderBy("ord"))
    seg = path.select("plan_id", F.struct("x", "y").alias("a"), nxt.alias("b"), F.count("*").over(W.partitionBy("plan_id")).alias("k")).filter("b IS NOT NULL OR k = 1").select("plan_id", "a", F.coalesce("b", "a").alias("b"))
    gap = vertices.join(seg, "plan_id").groupBy("plan_id", "i").agg(F.min(geom.segment_distance(F.struct("x", "y"), F.col("a"), F.col("b"))).alias("gap"))
    whole = W.partitionBy("plan_id")
    told = vertices.join(gap, ["plan_id", "i"], "left").withColumns({"n": F.count("*").over(whole), "r": F.row_number().over(whole.orderBy(F.col("gap").asc_nulls_last(), "i"))})
    return told.filter(F.col("gap").isNull() | (F.col("gap") > radius) | (F.col("r") > F.col("n") - least)).select("plan_id", "i", "x", "y")


def merge_rooms(held: DataFrame, new: DataFrame, near: float = 4.0) -> DataFrame:
    """held without the rooms that new ones replace, by label or, for those without, by an origin within near pixels, and new. Both: plan_id, label, x, y, source."""
    by_label = held.join(new.select("plan_id", "label").dropna(), ["plan_id", "label"], "left_anti")
    spot = new.filter("label IS NULL").select(F.col("plan_id").alias("p"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    rest = by_label.join(spot, (F.col("plan_id") == F.col("p")) & (F.abs(F.col("x") - F.col("nx")) <= near) & (F.abs(F.col("y") - F.col("ny")) <= near), "left_anti")
    return rest.unionByName(new)


def fan_out(warnings: DataFrame, floors: DataFrame) -> DataFrame:
    """A row for each floor that a warning concerns: all of the plan for the whole result's, else the floors it names. warnings: plan_id, code, scope, named array<bigint>."""
    on = (F.col("w.plan_id") == F.col("f.plan_id")) & ((F.col("scope") == "result") | F.array_contains("named", F.col("f.floor")))
    return warnings.alias("w").join(floors.alias("f"), on).select("w.plan_id", "f.floor", "w.code", "w.scope")


def twins(boxes: DataFrame, share: float = 0.65) -> DataFrame:
    """(plan_id, box_id, twins): how many other boxes of the plan overlap each by a share of the smaller. boxes: plan_id, box_id, box."""
    pair = meeting(boxes, boxes).filter(F.col("a.box_id") != F.col("b.box_id"))
    close = pair.filter(geom.overlap_ratio(F.col("a.box"), F.col("b.box")) > share).groupBy(F.col("a.plan_id").alias("plan_id"), F.col("a.box_id").alias("box_id")).agg(F.count("*").alias("n"))
    return boxes.select("plan_id", "box_id").join(close, ["plan_id", "box_id"], "left").select("plan_id", "box_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("twins"))


def uncovered(boxes: DataFrame, covers: DataFrame, share: float) -> DataFrame:
    """The boxes of which no cover of the plan covers more than a share: an anti join. Both: plan_id, box_id, box."""
    held = meeting(boxes, covers).filter(geom.cover_ratio(F.col("b.box"), F.col("a.box")) > share)
    return boxes.join(held.select(F.col("a.plan_id").alias("plan_id"), F.col("a.box_id").alias("box_id")).distinct(), ["plan_id", "box_id"], "left_anti")
