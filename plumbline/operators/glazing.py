"""Windows drawn as a screened band in the full thickness of a wall: grey, lighter than ink, darker than the page, with the same wall at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import floods
from plumbline.operators import raster as R

MARGIN = 12  # fixed value: how much darker than the page


def page_tone(cells: DataFrame, plan: list[str]) -> DataFrame:
    """(plan..., tone): the grey that most of what isn't ink has, with its neighbours at half weight; of equal ones the darkest. cells: plan..., gray, ink."""
    hist = cells.filter(~F.col("ink").cast("boolean")).groupBy(*plan, "gray").agg(F.count("*").alias("n"))
    near = hist.select(*plan, F.explode(F.array(*[F.struct((F.col("gray") + k).alias("v"), (F.col("n") * m).alias("m")) for k, m in ((-1, 1), (0, 2), (1, 1))])).alias("e"))
    mass = near.select(*plan, "e.v", "e.m").filter("v BETWEEN 1 AND 254").groupBy(*plan, "v").agg(F.sum("m").alias("m"))
    return mass.groupBy(*plan).agg(F.max(F.struct("m", (-F.col("v")).alias("_v"))).alias("b")).select(*plan, (-F.col("b._v")).alias("tone"))


def screened(cells: DataFrame, plan: list[str]) -> DataFrame:
    """Runs of what is no ink but darker than the page by more than MARGIN. cells: plan..., y, x, gray, ink."""
    dark = cells.join(page_tone(cells, plan), plan).filter(~F.col("ink").cast("boolean") & (F.col("gray") < F.col("tone") - MARGIN))
    return R.islands(dark.select(*plan, "y", "x"), [*plan, "y"], "x")


def _round(x: float) -> int:
    return int(x + 0.5)


def windows(bands: DataFrame, wall: DataFrame, plan: list[str], thickness: int, work) -> DataFrame:
    """(plan..., root, x0, y0, x1, y1, size): components of screened runs that are half a wall to 1.8 walls thick and three long, fill their box, and go on at both ends, within a
    wall's reach, into wall whose two faces are theirs. wall: plan..., y, x0, x1."""
    t = thickness
    part = work.save(floods.parts(bands, plan, work, "bands-"), "bands")
    size = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    each = part.groupBy(*plan, "root").agg(F.sum(size).alias("size"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    fits = F.least(w, h).between(max(2, _round(0.5 * t)), _round(1.8 * t)) & (F.greatest(w, h) >= max(3 * t, 12)) & (F.col("size") >= 0.55 * w * h)
    flat = w >= h
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    one = each.filter(fits).withColumns({"flat": flat, "lo": pick("y0", "x0"), "hi": pick("y1", "x1"), "begin": pick("x0", "y0"), "end": pick("x1", "y1")})
    reach, near = max(3, _round(0.6 * t)), max(2, _round(0.34 * t))
    past = lambda at, step: F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda d: F.struct(F.lit(step).alias("side"), (F.col(at) + step * d).alias("line")))
    at = one.withColumn("p", F.explode(F.concat(past("begin", -1), past("end", 1)))).select("*", "p.side", "p.line").drop("p")
    face = lambda flat_, df: df.select(*plan, F.lit(flat_).alias("flat"), F.col("y").alias("line"), F.col("x0").alias("a"), F.col("x1").alias("b"))
    faces = face(True, R.transposed(wall, plan)).unionByName(face(False, wall))
    mid: Column = F.floor((F.col("lo") + F.col("hi")) / 2)
    met = at.join(faces, [*plan, "flat", "line"]).filter(mid.between(F.col("a"), F.col("b")) & (F.abs(F.col("a") - F.col("lo")) <= near) & (F.abs(F.col("b") - F.col("hi")) <= near))
    ends = met.groupBy(*plan, "root").agg(F.count_distinct("side").alias("n")).filter("n = 2")
    return one.join(ends, [*plan, "root"], "left_semi").select(*plan, "root", "x0", "y0", "x1", "y1", "size")


def glazed_walls(wall: DataFrame, bands: DataFrame, plan: list[str], thickness: int, work) -> DataFrame:
    """wall with its windows as wall: what an outline is traced on."""
    found = windows(bands, wall, plan, thickness, work).select(*plan, "root")
    glass = floods.rows_of(work.spark.read.parquet(f"{work.root}/bands").join(found, [*plan, "root"], "left_semi"), plan)
    return R.union(wall.select(*plan, "y", "x0", "x1"), glass.select(*plan, "y", "x0", "x1"), plan)
