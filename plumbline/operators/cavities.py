"""Cavities inside a footprint: what lies behind each of their four sides, how much ink is in them, and which of them are garages; and rooms that hold no other room's label.

A march outwards from a cavity's edge is an interval: it ends where the footprint's run ends, and the wall in it is an overlap of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import floods
from plumbline.operators import raster as R

CAVITY = ["plan_id", "root"]
SIDES = ("left", "right", "top", "bottom")


def _round(x: float) -> int:
    return int(x + 0.5)


def _marches(cavity: DataFrame, footprint: DataFrame, wall: DataFrame, band: int, sides: tuple[str, str]) -> DataFrame:
    """(plan_id, root, side, pos, wall, exit): for each row of each cavity and both its ends, the wall pixels within band steps outwards inside the footprint, and the step that leaves it; null if none does."""
    ends = cavity.groupBy(*CAVITY, "y").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    foot = footprint.select("plan_id", "y", F.col("x0").alias("f0"), F.col("x1").alias("f1"))
    each = F.explode(F.array(F.struct(F.lit(sides[0]).alias("side"), F.col("lo").alias("edge"), F.lit(-1).alias("way")), F.struct(F.lit(sides[1]).alias("side"), F.col("hi").alias("edge"), F.lit(1).alias("way"))))
    at = ends.select(*CAVITY, "y", each.alias("e")).select(*CAVITY, "y", "e.side", "e.edge", "e.way")
    # the footprint's run that the first step is in; none if that step is outside
    met = at.join(foot, ["plan_id", "y"]).filter((F.col("edge") + F.col("way")).between(F.col("f0"), F.col("f1")))
    out = F.when(F.col("way") < 0, F.col("edge") - F.col("f0") + 1).otherwise(F.col("f1") - F.col("edge") + 1)
    key = [*CAVITY, "y", "side", "edge", "way"]
    step = at.join(met.select(*key, out.alias("exit")), key, "left").withColumn("exit", F.coalesce("exit", F.lit(1)))
    step = step.withColumn("reach", F.least(F.lit(band), F.col("exit") - 1))
    a = F.when(F.col("way") < 0, F.col("edge") - F.col("reach")).otherwise(F.col("edge") + 1)
    b = F.when(F.col("way") < 0, F.col("edge") - 1).otherwise(F.col("edge") + F.col("reach"))
    ink = step.withColumns({"a": a, "b": b}).join(wall.select("plan_id", "y", F.col("x0").alias("w0"), F.col("x1").alias("w1")), ["plan_id", "y"], "left")
    n = F.greatest(F.lit(0), F.least("b", "w1") - F.greatest("a", "w0") + 1)
    count = ink.groupBy(*CAVITY, "y", "side", "exit").agg(F.sum(F.coalesce(n, F.lit(0))).alias("wall"))
    return count.select(*CAVITY, "side", F.col("y").alias("pos"), "wall", F.when(F.col("exit") <= band, F.col("exit")).alias("exit"))


def measured_sides(cavity: DataFrame, footprint: DataFrame, wall: DataFrame, thickness: int) -> DataFrame:
    """(plan_id, root, side, len, door_frac, best_run, walled_frac): of each side, its length, the share of it that is a thin barrier to the outside, the longest stretch of such, and the share that is wall.

    cavity: plan_id, root, y, x0, x1. footprint, wall: plan_id, y, x0, x1. thickness: of the exterior walls.
    """
    band, thin = 3 * thickness + 6, max(2, _round(0.4 * thickness))
    walled = max(thin + 1, _round(0.6 * thickness))
    turn = lambda df, by: R.transposed(df, by)
    march = _marches(cavity, footprint, wall, band, SIDES[:2]).unionByName(_marches(turn(cavity, CAVITY), turn(footprint, ["plan_id"]), turn(wall, ["plan_id"]), band, SIDES[2:]))
    door = F.coalesce((F.col("wall") <= thin) & (F.col("exit") <= thin + 4), F.lit(False))
    one = march.withColumns({"door": door, "walled": F.col("wall") >= walled})
    box = floods.boxes(cavity, CAVITY)
    size = box.select(*CAVITY, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), ((F.col("by1") - F.col("by0") if s in SIDES[:2] else F.col("bx1") - F.col("bx0")) + 1).alias("len")) for s in SIDES])).alias("s")).select(*CAVITY, "s.side", "s.len")
    run = R.islands(one.filter("door"), [*CAVITY, "side"], "pos", "a", "b").groupBy(*CAVITY, "side").agg(F.max(F.col("b") - F.col("a") + 1).alias("best_run"))
    n = one.groupBy(*CAVITY, "side").agg(F.count_if("door").alias("doors"), F.count_if("walled").alias("walls"))
    return size.join(n, [*CAVITY, "side"]).join(run, [*CAVITY, "side"], "left").select(*CAVITY, "side", "len", (F.col("doors") / F.col("len")).alias("door_frac"), F.coalesce("best_run", F.lit(0)).alias("best_run"), (F.col("walls") / F.col("len")).alias("walled_frac"))


def ink_fraction(cavity: DataFrame, ink: DataFrame) -> DataFrame:
    """(plan_id, root, size, inked): the pixels of each cavity, and the share of them that is ink."""
    size = cavity.groupBy(*CAVITY).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    both = cavity.select(*CAVITY, "y", F.col("x0").alias("a"), F.col("x1").alias("b")).join(ink.select("plan_id", "y", "x0", "x1"), ["plan_id", "y"])
    hit = both.groupBy(*CAVITY).agg(F.sum(F.greatest(F.lit(0), F.least("b", "x1") - F.greatest("a", "x0") + 1)).alias("n"))
    return size.join(hit, CAVITY, "left").select(*CAVITY, "size", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("inked"))


def garages(cavity: DataFrame, footprint: DataFrame, wall: DataFrame, ink: DataFrame, thickness: int, least: int) -> DataFrame:
    """(plan_id, root, side): cavities that are garages, and the side of the door: a large, nearly rectangular and empty cavity of which one side is nearly all door, and the others are walls.

    Fixed values: a twentieth to 0.45 of the footprint, 0.7 of its own box, sides of 4 to 1, ink 0.04, a door of 0.65 of its side, walls of 0.55 on the others.
    """
    t = thickness
    area = footprint.groupBy("plan_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    w, h = F.col("bx1") - F.col("bx0") + 1, F.col("by1") - F.col("by0") + 1
    fits = (F.col("size") >= F.greatest(F.lit(least), 0.05 * F.col("area"))) & (F.col("size") <= 0.45 * F.col("area")) & (F.col("size") >= 0.7 * w * h) & (F.greatest(w, h) <= 4 * F.least(w, h)) & (F.col("inked") <= 0.04)
    some = ink_fraction(cavity, ink).join(floods.boxes(cavity, CAVITY), CAVITY).join(area, "plan_id").filter(fits).select(*CAVITY)
    side = measured_sides(cavity.join(some, CAVITY, "left_semi"), footprint, wall, t)
    door = (F.col("len") >= 3 * t) & (F.col("door_frac") >= 0.65) & (F.col("best_run") >= F.greatest(F.lit(2.5 * t), 0.3 * F.col("len")))
    place = F.array_position(F.array(*[F.lit(s) for s in SIDES]), F.col("side"))
    first = side.filter(door).groupBy(*CAVITY).agg(F.min(F.struct(place.alias("p"), "side")).alias("d")).select(*CAVITY, F.col("d.side").alias("door"))
    rest = side.join(first, CAVITY).filter("side != door").groupBy(*CAVITY, "door").agg((F.sum("walled_frac") / 3).alias("walled"))
    return rest.filter("walled >= 0.55").select(*CAVITY, F.col("door").alias("side"))


def stops(labels: DataFrame, walls: DataFrame, limits: DataFrame, reach: int) -> DataFrame:
    """(plan_id, label_id, side, at): where a room that grows from each label may end on each side, as the coordinate of its edge: the face of the nearest wall that it runs into, those of walls that it only
    passes by, at most reach beside it, up to there; and the edge of what the plan's widest footprint holds, where no wall comes before.

    labels: plan_id, label_id, x, y. walls: plan_id, dir (h or v), center, lo, hi, thickness. limits: plan_id, bx0, by0, bx1, by1, the extent of the widest footprint.
    """
    half = F.col("thickness") / 2

    def one(side: str) -> DataFrame:
        flat = side in SIDES[:2]
        own, beside = (F.col("x"), F.col("y")) if flat else (F.col("y"), F.col("x"))
        low = side in ("left", "top")
        met = labels.join(walls.filter(F.col("dir") == ("v" if flat else "h")), "plan_id").filter((F.col("lo") <= beside + reach) & (F.col("hi") >= beside - reach))
        met = met.filter(F.col("center") + half < own if low else F.col("center") - half > own)
        at, far = (F.col("center") + half, own - F.col("center")) if low else (F.col("center") - half, F.col("center") - own)
        edge = F.col({"left": "bx0", "right": "bx1", "top": "by0", "bottom": "by1"}[side]).cast("double")
        edge_far = own - edge if low else edge - own
        wall = met.select("plan_id", "label_id", at.alias("at"), far.alias("far"), beside.between(F.col("lo"), F.col("hi")).alias("full"))
        all_ = wall.unionByName(labels.join(limits, "plan_id").select("plan_id", "label_id", edge.alias("at"), edge_far.alias("far"), F.lit(True).alias("full")))
        nearest = F.min(F.when(F.col("full"), F.col("far"))).over(W.partitionBy("plan_id", "label_id"))
        return all_.withColumn("_n", nearest).filter("far <= _n").select("plan_id", "label_id", F.lit(side).alias("side"), "at").distinct()

    out = one(SIDES[0])
    for side in SIDES[1:]:
        out = out.unionByName(one(side))
    return out


def clamped_rooms(labels: DataFrame, walls: DataFrame, limits: DataFrame, reach: int) -> DataFrame:
    """(plan_id, label_id, x0, y0, x1, y1): the largest room between stops of each label that no other label of the plan is inside of; of equal ones the upper left. Labels where no such room is, have none."""
    s = stops(labels, walls, limits, reach)
    side = lambda name, c: s.filter(F.col("side") == name).select("plan_id", "label_id", F.col("at").alias(c))
    key = ["plan_id", "label_id"]
    box = side("left", "x0").join(side("right", "x1"), key).join(side("top", "y0"), key).join(side("bottom", "y1"), key)
    other = labels.select("plan_id", F.col("label_id").alias("_l"), "x", "y")
    foreign = box.alias("b").join(other.alias("o"), (F.col("b.plan_id") == F.col("o.plan_id")) & (F.col("label_id") != F.col("_l")) & (F.col("x0") < F.col("x")) & (F.col("x") < F.col("x1")) & (F.col("y0") < F.col("y")) & (F.col("y") < F.col("y1")), "left_anti")
    area: Column = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    place = F.row_number().over(W.partitionBy(*key).orderBy(area.desc(), "x0", "y0", "x1", "y1"))
    return foreign.withColumn("_p", place).filter("_p = 1").select(*key, "x0", "y0", "x1", "y1")
