"""Crops that one recogniser has failed on, laid out on sheets for another, and its boxes brought back to the crops.

A sheet is at most SIDE pixels wide and high. Crops stand below each other, PAD apart, scaled down where they are too wide; one that no longer fits begins the next sheet. That is a fold over a plan's
crops, which are few (ranking.capped_regions), so each plan is laid out by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, PAD = 960, 12  # fixed values


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def laid_out(crops: DataFrame) -> DataFrame:
    """(plan_id, roi_id, sheet, x, y, width, height, scale), in the order of roi_id. crops: plan_id, roi_id, width, height. A crop that is too high for a sheet of its own is scaled to fit; one without an area is left out."""
    most = float(SIDE - 2 * PAD)
    scale = F.least(F.lit(1.0), F.lit(most) / F.col("width"), F.lit(most) / F.col("height"))
    one = crops.filter("width > 0 AND height > 0").withColumn("scale", scale)
    one = one.select("plan_id", F.struct("roi_id", F.greatest(F.lit(1).cast("bigint"), _round(F.col("width") * F.col("scale"))).alias("w"), F.greatest(F.lit(1).cast("bigint"), _round(F.col("height") * F.col("scale"))).alias("h"), "scale").alias("c"))
    kind = one.schema["c"].dataType["roi_id"].dataType.simpleString()
    per = one.groupBy("plan_id").agg(F.sort_array(F.collect_list("c")).alias("c"))

    def step(s: Column, c: Column) -> Column:
        fits = s["y"] + c["h"] <= SIDE - PAD
        sheet, y = F.when(fits, s["sheet"]).otherwise(s["sheet"] + 1), F.when(fits, s["y"]).otherwise(F.lit(PAD).cast("bigint"))
        row = F.struct(c["roi_id"].alias("roi_id"), sheet.alias("sheet"), y.alias("y"), c["w"].alias("width"), c["h"].alias("height"), c["scale"].alias("scale"))
        return F.struct(sheet.alias("sheet"), (y + c["h"] + PAD).alias("y"), F.concat(s["out"], F.array(row)).alias("out"))

    none = F.array().cast(f"array<struct<roi_id:{kind},sheet:int,y:bigint,width:bigint,height:bigint,scale:double>>")
    start = F.struct(F.lit(0).alias("sheet"), F.lit(PAD).cast("bigint").alias("y"), none.alias("out"))
    out = per.select("plan_id", F.explode(F.aggregate("c", start, step)["out"]).alias("r"))
    return out.select("plan_id", "r.roi_id", "r.sheet", F.lit(PAD).cast("bigint").alias("x"), "r.y", "r.width", "r.height", "r.scale")


def brought_back(found: DataFrame, layout: DataFrame) -> DataFrame:
    """(plan_id, roi_id, text, x0, y0, x1, y1): what was recognised on a sheet, with its box in the crop's own pixels. found: plan_id, sheet, text, x0, y0, x1, y1.

    A box belongs to the first crop in whose rectangle its middle is, PAD wider on the left and right and half of it above and below; boxes of none, and empty texts, go.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    at = layout.select("plan_id", "sheet", "roi_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "width", "height", "scale")
    met = found.filter(F.length("text") > 0).join(at, ["plan_id", "sheet"])
    met = met.filter(cx.between(F.col("_x") - PAD, F.col("_x") + F.col("width") + PAD) & cy.between(F.col("_y") - PAD / 2, F.col("_y") + F.col("height") + PAD / 2))
    key = ["plan_id", "sheet", "text", "x0", "y0", "x1", "y1"]
    one = met.groupBy(*key).agg(F.min(F.struct("_y", "roi_id", "_x", "scale")).alias("t"))
    back = lambda c, o: ((F.col(c) - F.col(f"t.{o}")) / F.col("t.scale")).alias(c)
    return one.select("plan_id", "t.roi_id", "text", back("x0", "_x"), back("y0", "_y"), back("x1", "_x"), back("y1", "_y"))
