"""Ruling lines across recognised text: chains of dashes and long thin lines, as a mask to take out before text is read; and rails beside a line of text.

A dash is a whole component that is thin across the line. Dashes in one row chain up while the gaps between them are short, or long but crossed by other thin ink. Hyphens
between digits stay: they have tall ink close by on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import floods
from plumbline.operators import raster as R

# Fixed values, in pixels: how thick a line is at most; a chain's dashes and span; a dash's length and the gaps within a chain, with and without thin ink in them; a
# line on its own; ink that makes up for few dashes; how close tall ink is to a hyphen; rows about a line that are its own.
THICK, CHAIN, SPAN, DASH, GAP, BRIDGE, SOLID, INK, HYPHEN, ROWS = 4, 5, 64, 48, 24, 320, 90, 60, 9, 2


def _along(ink: DataFrame, plan: list[str], work, name: str) -> DataFrame:
    """The mask of lines along rows, as runs along columns: (plan..., y, x0, x1) with x and y exchanged."""
    order = W.partitionBy(*plan, "x").orderBy("top")
    across = R.transposed(ink, plan).select(*plan, F.col("y").alias("x"), F.col("x0").alias("top"), F.col("x1").alias("end"))
    beside = F.coalesce(F.lag("end").over(order) == F.col("top") - 2, F.lit(False)) | F.coalesce(F.lead("top").over(order) == F.col("end") + 2, F.lit(False))
    across = work.save(across.withColumns({"beside": beside, "thin": F.col("end") - F.col("top") + 1 <= THICK}), f"{name}across")
    thin, tall = across.filter("thin"), across.filter("NOT thin")
    cell = thin.select(*plan, "x", F.explode(F.sequence("top", "end")).alias("y"))
    seg = work.save(R.islands(cell, [*plan, "y"], "x", "a", "b").withColumn("n", F.col("b") - F.col("a") + 1), f"{name}segments")
    # whether a piece's middle is in a component that is thin as a whole
    part = floods.parts(ink, plan, work, f"{name}of-")
    flat = part.groupBy(*plan, "root").agg((F.max("y1") - F.min("y0") + 1 <= THICK).alias("flat"))
    row = part.join(flat, [*plan, "root"]).select(*plan, F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1", "flat")
    mid = F.floor((F.col("a") + F.col("b")) / 2)
    seg = seg.join(row, [*plan, "y"]).filter(mid.between(F.col("x0"), F.col("x1"))).select(*plan, "y", "a", "b", "n", "flat")
    # a long piece is a line if little of it has other ink right above or below
    long = seg.filter(F.col("n") >= DASH).select(*plan, "y", "a", "b", F.explode(F.sequence("a", "b", F.lit(2).cast("bigint"))).alias("x"))
    clean = long.join(across, [*plan, "x"]).filter("y BETWEEN top AND end").groupBy(*plan, "y", "a", "b").agg((F.avg(F.col("beside").cast("int")) <= 0.25).alias("clean"))
    seg = work.save(seg.join(clean, [*plan, "y", "a", "b"], "left").withColumn("clean", F.coalesce("clean", F.lit(False))), f"{name}judged")
    member = seg.filter(F.when(F.col("flat"), F.col("n").between(THICK + 2, DASH)).otherwise(F.col("clean") & (F.col("n") >= DASH)))
    line = W.partitionBy(*plan, "y").orderBy("a")
    member = work.save(member.withColumn("before", F.lag("b").over(line)).withColumn("gap", F.col("a") - F.col("before") - 1), f"{name}members")
    wide = member.filter((F.col("gap") > GAP) & (F.col("gap") <= BRIDGE)).select(*plan, "y", "a", F.explode(F.sequence(F.col("before") + 1, F.col("a") - 1)).alias("x"))
    over = wide.join(thin, [*plan, "x"]).filter((F.col("top") <= F.col("y") + ROWS) & (F.col("end") >= F.col("y") - ROWS)).groupBy(*plan, "y", "a").agg(F.count_distinct("x").alias("covered"))
    goes_on = (F.col("gap") <= GAP) | (F.col("gap") <= BRIDGE) & (F.coalesce("covered", F.lit(0)) >= 0.12 * F.col("gap"))
    chain = member.join(over, [*plan, "y", "a"], "left").withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_c", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    chain = chain.groupBy(*plan, "y", "_c").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("k"), F.sum("n").alias("ink")).filter((F.col("b") - F.col("a") >= SPAN) & ((F.col("k") >= CHAIN) | (F.col("ink") >= INK)))
    span = chain.select(*plan, "y", "a", "b").unionByName(seg.filter(F.col("clean") & (F.col("n") >= SOLID)).select(*plan, "y", "a", "b")).distinct()
    # in each column of a line, the uppermost thin ink about its row
    spot = span.select(*plan, "y", F.explode(F.sequence("a", "b")).alias("x")).distinct().join(thin, [*plan, "x"]).filter((F.col("top") <= F.col("y") + ROWS) & (F.col("end") >= F.col("y") - ROWS))
    spot = spot.groupBy(*plan, "y", "x").agg(F.min(F.struct("top", "end")).alias("r")).select(*plan, "x", "r.top", "r.end", F.greatest(F.col("r.top"), F.col("y") - ROWS).alias("p")).distinct()
    spot = work.save(spot, f"{name}spots")
    reach = F.sequence(F.lit(-HYPHEN), F.lit(HYPHEN))
    look = spot.select(*plan, F.col("x").alias("at"), "p", F.explode(F.filter(reach, lambda k: k != 0)).alias("k")).withColumn("x", F.col("at") + F.col("k"))
    met = look.join(tall.select(*plan, "x", "top", "end"), [*plan, "x"]).filter((F.col("top") <= F.col("p") + 1) & (F.col("end") >= F.col("p") - 1))
    hyphen = met.groupBy(*plan, F.col("at").alias("x"), "p").agg(F.count_distinct(F.signum("k")).alias("sides")).filter("sides = 2")
    own = spot.join(hyphen, [*plan, "x", "p"], "left_anti")
    return R.merged(own.select(*plan, F.col("x").alias("y"), F.col("top").alias("x0"), F.col("end").alias("x1")), [*plan, "y"])


def ruling_lines(ink: DataFrame, plan: list[str], work) -> DataFrame:
    """(plan..., y, x0, x1): the ink of ruling lines along rows and columns."""
    ink = work.save(ink.select(*plan, "y", "x0", "x1"), "ink")
    turned = work.save(R.transposed(ink, plan), "turned")
    rows = R.transposed(_along(ink, plan, work, "h-"), plan)
    return R.union(rows, _along(turned, plan, work, "v-"), plan)


def without_rails(ink: DataFrame, plan: list[str], size: DataFrame, margin_lo: int = 0, margin_hi: int = 0) -> DataFrame:
    """ink less narrow bands at the left and right ends that are no text: rails of a frame beside it. size: plan..., width.

    Bands are columns of ink with a blank one between them at most. The widest is text, and its height that of the text. An outer band no wider than a quarter of it is a rail if it is in a margin,
    farther off the next one than 0.9 of it, or taller than 1.2 of it; one about as tall as the text and close to it is a digit, where text is 12 pixels high or more.
    """
    up = R.transposed(ink, plan).groupBy(*plan, F.col("y").alias("x")).agg(F.min("x0").alias("top"), F.max("x1").alias("end"))
    line = W.partitionBy(*plan).orderBy("x")
    up = up.withColumn("_b", F.when(F.col("x") - F.lag("x").over(line) <= 2, 0).otherwise(1)).withColumn("i", F.sum("_b").over(line.rowsBetween(W.unboundedPreceding, 0)))
    band = up.groupBy(*plan, "i").agg(F.min("x").alias("a"), F.max("x").alias("b"), (F.max("end") - F.min("top") + 1).alias("h")).join(size, plan)
    band = band.withColumn("b", F.when(F.col("width") - 1 - F.col("b") <= 1, F.col("width") - 1).otherwise(F.col("b")))  # the last band goes on to the edge
    whole, order = W.partitionBy(*plan), W.partitionBy(*plan).orderBy("i")
    band = band.withColumn("text", F.max(F.struct((F.col("b") - F.col("a")).alias("w"), (-F.col("i")).alias("k"), F.col("h").alias("h"))).over(whole)["h"]).withColumn("n", F.count("*").over(whole))

    def rail(gap: Column) -> Column:
        t = F.col("text")
        digit = (t >= 12) & (F.col("h") >= 0.55 * t) & (F.col("h") < 1.2 * t) & (gap < 0.9 * t)
        margin = (F.lit(margin_lo) > 0) & (F.col("b") < margin_lo) | (F.lit(margin_hi) > 0) & (F.col("a") > F.col("width") - 1 - margin_hi)
        return F.coalesce((F.col("b") - F.col("a") + 1 <= F.greatest(F.lit(2.0), 0.25 * t)) & ~digit & (margin | (gap >= 0.9 * t) | (F.col("h") >= 1.2 * t)), F.lit(False))

    band = band.withColumns({"left": rail(F.lead("a").over(order) - F.col("b")), "right": rail(F.col("a") - F.lag("b").over(order))})
    lo = band.groupBy(*plan).agg(F.coalesce(F.min(F.when(~F.col("left"), F.col("i"))), F.max("i")).alias("lo"))
    hi = band.join(lo, plan).groupBy(*plan).agg(F.first("lo").alias("lo"), F.coalesce(F.max(F.when(~F.col("right") & (F.col("i") >= F.col("lo")), F.col("i"))), F.first("lo")).alias("hi"))
    kept = band.join(hi, plan).filter("i BETWEEN lo AND hi").groupBy(*plan).agg(F.min("a").alias("ka"), F.max("b").alias("kb"))
    cut = ink.join(kept, plan).filter("x1 >= ka AND x0 <= kb")
    return cut.select(*plan, "y", F.greatest("x0", "ka").alias("x0"), F.least("x1", "kb").alias("x1"))
