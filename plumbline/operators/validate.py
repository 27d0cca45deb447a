"""Rules that a traced result has to pass: a warning for each one broken, and what they leave of its confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.functions.scale import constraint_factor

# Shares of the page, of the outer area, and of the smaller of two floors; factors stand beside the rules.
COVERS, TINY, OVER_INSET, OVERLAP, GRID = 0.92, 0.005, 0.45, 0.4, 96
# Boxes below the first share of the plan's largest are no buildings; nor those below the second whose walls are hairlines, the largest outline (by area) apart.
SMALL_BOX, LESSER_BOX, HAIRLINES, LARGEST = 0.12, 0.55, 0.35, 0.999


def sampled_overlap(a: Column, b: Column, steps: int = GRID) -> Column:
    """Shared area of two rings, by points in the middles of a grid over the shared box."""
    ba, bb = geom.bounds(a), geom.bounds(b)
    x0, x1, y0, y1 = F.greatest(ba["x0"], bb["x0"]), F.least(ba["x1"], bb["x1"]), F.greatest(ba["y0"], bb["y0"]), F.least(ba["y1"], bb["y1"])
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    at = lambda lo, hi, k: lo + (k + 0.5) * (hi - lo) / steps

    def hits(ea: Column, eb: Column) -> Column:
        row = lambda y: F.aggregate(grid, F.lit(0), lambda n, i: n + F.when(_in(ea, at(x0, x1, i), y) & _in(eb, at(x0, x1, i), y), 1).otherwise(0))
        return F.aggregate(grid, F.lit(0), lambda n, j: n + row(at(y0, y1, j)))

    inside = geom.let(geom.edges(a), lambda ea: geom.let(geom.edges(b), lambda eb: hits(ea, eb)))
    return F.when((x1 > x0) & (y1 > y0), inside / (steps * steps) * (x1 - x0) * (y1 - y0)).otherwise(F.lit(0.0))


def _in(e: Column, x: Column, y: Column) -> Column:
    return geom._odd(F.struct(x.alias("x"), y.alias("y")), e)


def floor_warnings(floors: DataFrame, images: DataFrame) -> DataFrame:
    """(plan_id, floor, code, severity, factor): rules on each floor. floors: plan_id, floor, outer, inner (rings), holes array of rings. images: plan_id, width, height."""
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    one = floors.join(images, "plan_id").withColumns({"page": F.col("width") * F.col("height"), "area": geom.net_area_px(F.col("outer"), F.coalesce("holes", none)), "inside": geom.ring_area(F.col("inner"))})
    whole, has = F.coalesce(F.size("outer") >= 3, F.lit(False)), F.coalesce(F.size("inner") >= 3, F.lit(False))
    rule = lambda when, code, severity, factor: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(factor).alias("factor")))
    rules = F.array(
        rule(~whole, "floor-empty", "error", 0.5),
        rule(whole & geom.self_intersects(F.col("outer")), "self-intersecting", "error", 0.5),
        rule(whole & (F.col("page") > 0) & (F.col("area") > COVERS * F.col("page")), "covers-page", "error", 0.4),
        rule(whole & (F.col("page") > 0) & (F.col("area") < TINY * F.col("page")), "tiny-floor", "warn", 0.7),
        rule(whole & has & (F.col("inside") >= F.col("area")), "inner-not-nested", "error", 0.6),
        rule(whole & has & (F.col("inside") < OVER_INSET * F.col("area")), "inner-over-inset", "warn", 0.85),
        rule(whole & ~has, "no-inner", "warn", 0.9),
    )
    return one.select("plan_id", "floor", F.explode(F.array_compact(rules)).alias("w")).select("plan_id", "floor", "w.*")


def overlap_warnings(floors: DataFrame) -> DataFrame:
    """The same columns, for the lower of each pair of floors that share too much."""
    a, b = floors.select("plan_id", F.col("floor"), F.col("outer").alias("a")), floors.select("plan_id", F.col("floor").alias("other"), F.col("outer").alias("b"))
    pair = a.join(b, "plan_id").filter((F.col("floor") < F.col("other")) & geom.boxes_meet(geom.bounds(F.col("a")), geom.bounds(F.col("b"))))
    least = F.least(geom.ring_area(F.col("a")), geom.ring_area(F.col("b")))
    return pair.filter((least > 0) & (sampled_overlap(F.col("a"), F.col("b")) > OVERLAP * least)).select("plan_id", "floor", F.lit("floors-overlap").alias("code"), F.lit("error").alias("severity"), F.lit(0.6).alias("factor"))


def label_warnings(floors: DataFrame, marks: DataFrame, drawn: bool = False) -> DataFrame:
    """The same columns, one row for each plan with labels outside all floors: an anti join, and the share that is outside. marks: plan_id, label_id, x, y."""
    inside = geom.in_ring(F.struct(F.col("m.x").alias("x"), F.col("m.y").alias("y")), F.col("f.outer"))
    out = marks.alias("m").join(floors.alias("f"), (F.col("m.plan_id") == F.col("f.plan_id")) & inside, "left_anti").groupBy("plan_id").agg(F.count("*").alias("missed"))
    of = marks.groupBy("plan_id").agg(F.count("*").alias("total"))
    return out.join(of, "plan_id").select("plan_id", F.lit(None).cast("bigint").alias("floor"), F.lit("label-outside").alias("code"), F.lit("warn" if drawn else "error").alias("severity"), constraint_factor(F.col("missed"), F.col("total"), F.lit(drawn)).alias("factor"))


def confidence_factor(warnings: DataFrame) -> DataFrame:
    """(plan_id, factor, n): the product of the factors, within 0 and 1."""
    return warnings.groupBy("plan_id").agg(F.least(F.lit(1.0), F.aggregate(F.array_sort(F.collect_list("factor")), F.lit(1.0), lambda a, x: a * x)).alias("factor"), F.count("*").alias("n"))


def buildings(floors: DataFrame) -> DataFrame:
    """floors with building, whether each outline is one rather than a legend, a title block or a detail, and rejected, how many of its plan's are not. A plan of which nothing would be left keeps the outline of least floor.

    floors: plan_id, floor, ring, structural (the share of its ink that is thick), held (whether it holds a place known to be inside; null as false).
    """
    plan, b = W.partitionBy("plan_id"), geom.bounds(F.col("ring"))
    size = floors.withColumns({"_box": geom.let(b, lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])), "_area": geom.ring_area(F.col("ring"))})
    of = size.withColumns({"_box": F.col("_box") / F.nullif(F.max("_box").over(plan), F.lit(0.0)), "_area": F.col("_area") / F.nullif(F.max("_area").over(plan), F.lit(0.0))})
    legend = (F.col("_area") < LARGEST) & (F.col("_box") < LESSER_BOX) & (F.col("structural") < HAIRLINES) & ~F.coalesce("held", F.lit(False))
    # sizes that are no numbers (no ring, no area) say nothing against an outline
    told = of.withColumn("_out", F.coalesce((F.col("_box") < SMALL_BOX) | legend, F.lit(False)))
    kept = told.withColumn("building", ~F.col("_out") | (F.min("_out").over(plan) & (F.col("floor") == F.min("floor").over(plan))))
    return kept.withColumn("rejected", F.count_if(~F.col("building")).over(plan)).drop("_box", "_area", "_out")
