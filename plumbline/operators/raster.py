"""Binary rasters as run tables: (plan..., y, x0, x1) with both ends inside, sorted and apart. Rows of ink are few on line art, so
morphology, unions and sums on runs touch far less than a row for each pixel would.

All windows are partitioned by the plan and a row or column, so a plan's work is spread over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def large(df: DataFrame) -> DataFrame:
    """df, never to be broadcast in a join: Spark takes what is exploded to be as large as what it was made of, and what is saved to be as large as its packed file, and would hold it on the driver."""
    return df.hint("merge")


def islands(df: DataFrame, by: list[str], at: str, lo: str = "x0", hi: str = "x1") -> DataFrame:
    """The maximal stretches of consecutive whole numbers at within each group of by; at must be distinct there."""
    key = F.col(at) - F.row_number().over(W.partitionBy(*by).orderBy(at))
    return df.select(*by, F.col(at), key.alias("_k")).groupBy(*by, "_k").agg(F.min(at).alias(lo), F.max(at).alias(hi)).drop("_k")


def merged(runs: DataFrame, by: list[str], lo: str = "x0", hi: str = "x1", gap: int = 0) -> DataFrame:
    """Runs that overlap, touch, or lie no more than gap apart, as one."""
    order = W.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.col(lo) > reach + 1 + gap, 1).otherwise(F.when(reach.isNull(), 1).otherwise(0))
    marked = runs.select(*by, lo, hi, begins.alias("_b")).withColumn("_g", F.sum("_b").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_g")


def pixels(runs: DataFrame, by: list[str]) -> DataFrame:
    """A row for each pixel of ink."""
    return runs.select(*by, F.explode(F.sequence("x0", "x1")).alias("x"))


def transposed(runs: DataFrame, plan: list[str]) -> DataFrame:
    """The same ink in runs along columns, named as rows: (plan..., y, x0, x1) with x and y exchanged. Rows in which the same run stands are one block first, so a wall is a piece for each column, not for each pixel."""
    block = islands(runs.select(*plan, "x0", "x1", "y"), [*plan, "x0", "x1"], "y", "_y0", "_y1")
    piece = block.select(*plan, F.explode(F.sequence("x0", "x1")).alias("y"), F.col("_y0").alias("x0"), F.col("_y1").alias("x1"))
    return merged(piece, [*plan, "y"])


def dilate_rows(runs: DataFrame, plan: list[str], r: int, width: int) -> DataFrame:
    """Ink wherever there is some within r along the row, inside the width."""
    grown = runs.select(*plan, "y", F.greatest(F.col("x0") - r, F.lit(0)).alias("x0"), F.least(F.col("x1") + r, F.lit(width - 1)).alias("x1"))
    return merged(grown.filter("x0 <= x1"), [*plan, "y"])


def erode_rows(runs: DataFrame, plan: list[str], r: int) -> DataFrame:
    """Ink where all within r along the row is ink; beyond the border there is none."""
    return runs.select(*plan, "y", (F.col("x0") + r).alias("x0"), (F.col("x1") - r).alias("x1")).filter("x0 <= x1")


def dilate(runs: DataFrame, plan: list[str], r: int, width: int, height: int) -> DataFrame:
    """Square dilation, inside the canvas."""
    across = transposed(dilate_rows(runs, plan, r, width), plan)
    return transposed(dilate_rows(across, plan, r, height), plan)


def erode(runs: DataFrame, plan: list[str], r: int) -> DataFrame:
    """Square erosion; beyond the canvas there is no ink."""
    return transposed(erode_rows(transposed(erode_rows(runs, plan, r), plan), plan, r), plan)


def opened(runs: DataFrame, plan: list[str], r: int, width: int, height: int) -> DataFrame:
    return dilate(erode(runs, plan, r), plan, r, width, height)


def closed(runs: DataFrame, plan: list[str], r: int, width: int, height: int) -> DataFrame:
    """Square closing on a canvas that is r wider on each side, so that ink near the border isn't lost."""
    moved = runs.select(*plan, (F.col("y") + r).alias("y"), (F.col("x0") + r).alias("x0"), (F.col("x1") + r).alias("x1"))
    shut = erode(dilate(moved, plan, r, width + 2 * r, height + 2 * r), plan, r)
    back = shut.select(*plan, (F.col("y") - r).alias("y"), F.greatest(F.col("x0") - r, F.lit(0)).alias("x0"), F.least(F.col("x1") - r, F.lit(width - 1)).alias("x1"))
    return back.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") <= F.col("x1")))


def long_runs(runs: DataFrame, plan: list[str], length: int, direction: str) -> DataFrame:
    """Pixels (plan..., y, x) of runs of so many pixels at least along h, v, or one of the diagonals d (x - y) and a (x + y)."""
    cells = pixels(runs, [*plan, "y"])
    line = {"h": F.col("y"), "v": F.col("x"), "d": F.col("x") - F.col("y"), "a": F.col("x") + F.col("y")}[direction]
    along = "y" if direction == "v" else "x"
    long = islands(cells.withColumn("_line", line), [*plan, "_line"], along).filter(F.col("x1") - F.col("x0") + 1 >= length)
    at = long.select(*plan, "_line", F.explode(F.sequence("x0", "x1")).alias("_at"))
    x, y = {"h": (F.col("_at"), F.col("_line")), "v": (F.col("_line"), F.col("_at")), "d": (F.col("_at"), F.col("_at") - F.col("_line")), "a": (F.col("_at"), F.col("_line") - F.col("_at"))}[direction]
    return at.select(*plan, y.alias("y"), x.alias("x"))


def bridges(runs: DataFrame, plan: list[str], gap: int, flank: int) -> DataFrame:
    """The gaps, as runs, of at most gap pixels between successive runs of a row that are flank long at least; runs too short to flank are passed over as if blank."""
    solid = runs.filter(F.col("x1") - F.col("x0") + 1 >= flank)
    before = F.lag("x1").over(W.partitionBy(*plan, "y").orderBy("x0"))
    hole = solid.select(*plan, "y", (before + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    return hole.filter((F.col("x1") >= F.col("x0")) & (F.col("x1") - F.col("x0") + 1 <= gap))


def bridged(runs: DataFrame, plan: list[str], gap: int, flank: int) -> DataFrame:
    """Ink with the gaps of rows and of columns filled, both found on the ink as it was."""
    rows = bridges(runs, plan, gap, flank)
    cols = transposed(bridges(transposed(runs, plan), plan, gap, flank), plan)
    return merged(runs.select(*plan, "y", "x0", "x1").unionByName(rows).unionByName(cols), [*plan, "y"])


def union(a: DataFrame, b: DataFrame, plan: list[str]) -> DataFrame:
    return merged(a.unionByName(b), [*plan, "y"])


def difference(a: DataFrame, b: DataFrame, plan: list[str]) -> DataFrame:
    """Ink of a that isn't in b: the stretches between ends of runs that lie in a and not in b, so that no row is made for a pixel."""
    end = lambda at, n, m: F.struct(at.alias("x"), F.lit(n).alias("_a"), F.lit(m).alias("_b"))
    ends = lambda df, n, m: df.select(*plan, "y", F.explode(F.array(end(F.col("x0"), n, m), end(F.col("x1") + 1, -n, -m))).alias("e")).select(*plan, "y", "e.*")
    at = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy(*plan, "y", "x").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    order = W.partitionBy(*plan, "y").orderBy("x")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    cut = at.select(*plan, "y", F.col("x").alias("x0"), (F.lead("x").over(order) - 1).alias("x1"), F.sum("_a").over(upto).alias("_a"), F.sum("_b").over(upto).alias("_b"))
    return merged(cut.filter("_a > 0 AND _b = 0"), [*plan, "y"])


def ink_bounds(runs: DataFrame, plan: list[str]) -> DataFrame:
    """Extent and amount of ink."""
    return runs.groupBy(*plan).agg(F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.max("x1").alias("max_x"), F.max("y").alias("max_y"), F.sum(F.col("x1") - F.col("x0") + 1).alias("ink"))


def stroke_thickness(runs: DataFrame, plan: list[str], longest: int, default: int = 2) -> DataFrame:
    """The length of short runs, along rows and columns, that holds most of their ink; of equal ones the shortest."""
    both = runs.select(*plan, "y", "x0", "x1").unionByName(transposed(runs, plan))
    n = both.select(*plan, (F.col("x1") - F.col("x0") + 1).alias("n"))
    mass = n.groupBy(*plan, "n").agg(F.sum("n").alias("mass"))
    best = mass.filter(F.col("n") <= longest).groupBy(*plan).agg(F.max(F.struct("mass", (-F.col("n")).alias("m"))).alias("b"))
    return n.select(*plan).distinct().join(best, plan, "left").select(*plan, F.coalesce(-F.col("b.m"), F.lit(default)).alias("thickness"))


def prefix_sums(cells: DataFrame, plan: list[str], value: str) -> DataFrame:
    """Summed-area table over the cells that are there: for each (y, x), the sum of value up and left of it, itself included, by rows and then columns of the dense grid given."""
    row = F.sum(value).over(W.partitionBy(*plan, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn("_row", row).withColumn("sat", F.sum("_row").over(W.partitionBy(*plan, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0))).drop("_row")


def histogram(cells: DataFrame, plan: list[str], value: str = "gray") -> DataFrame:
    return cells.groupBy(*plan, F.col(value).alias("level")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, plan: list[str], lo: int = 0, hi: int = 256) -> DataFrame:
    """(plan..., threshold, total): the level after which the two classes differ most between them; of equal ones the first. The last class is never empty."""
    h = hist.filter((F.col("level") >= lo) & (F.col("level") < hi))
    upto = W.partitionBy(*plan).orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*plan)
    run = h.withColumns({"nb": F.sum("n").over(upto), "sb": F.sum(F.col("n") * F.col("level")).over(upto), "total": F.sum("n").over(whole), "all": F.sum(F.col("n") * F.col("level")).over(whole)})
    nf = F.col("total") - F.col("nb")
    gap = F.col("sb") / F.col("nb") - (F.col("all") - F.col("sb")) / F.nullif(nf, F.lit(0))
    spread = F.when(nf > 0, F.col("nb").cast("double") * nf * gap * gap)
    best = run.withColumn("v", F.coalesce(spread, F.lit(-1.0))).groupBy(*plan).agg(F.max(F.struct("v", (-F.col("level")).alias("l"))).alias("b"), F.max("total").alias("total"))
    return best.select(*plan, (-F.col("b.l")).alias("threshold"), "total")


def connected(nodes: DataFrame, edges: DataFrame, plan: list[str], work, name: str = "") -> DataFrame:
    """(plan..., id, root): the least id that can be reached from each node. nodes: plan..., id. edges: plan..., u, v, either way.

    The steps are minima over neighbours and jumps to the neighbour's own minimum, each written by work.save(df, name) until nothing changes.
    """
    edge = work.save(edges.select(*plan, "u", "v").unionByName(edges.select(*plan, F.col("v").alias("u"), F.col("u").alias("v"))), f"{name}edges")
    label = work.save(nodes.select(*plan, "id", F.col("id").alias("root")), f"{name}label0")
    turn = 0
    while True:
        turn += 1
        near = edge.join(large(label.select(*plan, F.col("id").alias("v"), F.col("root").alias("r"))), [*plan, "v"]).groupBy(*plan, F.col("u").alias("id")).agg(F.min("r").alias("r"))
        low = label.join(large(near), [*plan, "id"], "left").select(*plan, "id", "root", F.least("root", "r").alias("new"))
        jump = low.select(*plan, F.col("id").alias("new"), F.col("new").alias("far"))
        now = work.save(low.join(large(jump), [*plan, "new"], "left").select(*plan, "id", F.col("root").alias("old"), F.least("new", "far").alias("root")), f"{name}label{turn}")
        if not now.filter("root != old").limit(1).count():
            return now.select(*plan, "id", "root")
        work.drop(f"{name}label{turn - 1}")
        label = now.drop("old")


def components(runs: DataFrame, plan: list[str], work, diagonal: bool = False, name: str = "") -> DataFrame:
    """Runs with the least run number (y, x0 packed) of their component: neighbours in the next row that overlap, with a pixel's slack for 8-connectivity."""
    slack = 1 if diagonal else 0
    one = runs.select(*plan, "y", "x0", "x1", (F.col("y") * 1048576 + F.col("x0")).alias("id"))
    a, b = one.alias("a"), one.alias("b")
    on = (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.x0") <= F.col("b.x1") + slack) & (F.col("b.x0") <= F.col("a.x1") + slack)
    for c in plan:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    edge = a.join(large(b), on).select(*[F.col(f"a.{c}").alias(c) for c in plan], F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    return one.join(large(connected(one, edge, plan, work, name)), [*plan, "id"])


# Grey pixels in long form: (plan..., y, x, gray).


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of three bytes."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def binarized(cells: DataFrame, plan: list[str], threshold: Column) -> DataFrame:
    """cells with ink: what is darker than the threshold, or what is lighter where most is darker."""
    dark = (F.col("gray") < threshold).cast("int")
    whole = W.partitionBy(*plan)
    return cells.withColumn("_d", dark).withColumn("ink", F.when(F.sum("_d").over(whole) * 2 > F.count("*").over(whole), 1 - F.col("_d")).otherwise(F.col("_d"))).drop("_d")


def stretched(cells: DataFrame, plan: list[str], lo: float, hi: float) -> DataFrame:
    """gray drawn out so that the levels at two shares of the pixels become 0 and 255."""
    h = histogram(cells, plan)
    upto = F.sum("n").over(W.partitionBy(*plan).orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    at = h.withColumns({"c": upto, "t": F.sum("n").over(W.partitionBy(*plan))}).groupBy(*plan).agg(F.min(F.when(F.col("c") >= lo * F.col("t"), F.col("level"))).alias("_a"), F.min(F.when(F.col("c") >= hi * F.col("t"), F.col("level"))).alias("_b"))
    new = F.when(F.col("_b") > F.col("_a"), F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("gray") - F.col("_a")) * 255 / (F.col("_b") - F.col("_a")))))).otherwise(F.col("gray"))
    return cells.join(at, plan).withColumn("gray", new.cast("bigint")).drop("_a", "_b")


def cropped(runs: DataFrame, plan: list[str], x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The ink inside a box, with the box's corner as origin."""
    cut = runs.filter(F.col("y").between(y0, y1) & (F.col("x1") >= x0) & (F.col("x0") <= x1))
    return cut.select(*plan, (F.col("y") - y0).alias("y"), (F.greatest(F.col("x0"), F.lit(x0)) - x0).alias("x0"), (F.least(F.col("x1"), F.lit(x1)) - x0).alias("x1"))


def turned(runs: DataFrame, plan: list[str], width: int, height: int, clockwise: bool = True) -> DataFrame:
    """The ink turned by a right angle."""
    cell = pixels(runs, [*plan, "y"])
    x, y = (F.lit(height - 1) - F.col("y"), F.col("x")) if clockwise else (F.col("y"), F.lit(width - 1) - F.col("x"))
    return islands(cell.select(*plan, y.alias("y"), x.alias("x")), [*plan, "y"], "x")


def pooled(cells: DataFrame, plan: list[str], factor: int) -> DataFrame:
    """Cells of factor by factor pixels: ink if any pixel is, gray as the mean, halves up. cells: y, x, ink, gray."""
    at = [F.floor(F.col(c) / factor).alias(c) for c in ("y", "x")]
    return cells.groupBy(*plan, *at).agg(F.max("ink").alias("ink"), F.floor(F.avg("gray") + 0.5).cast("bigint").alias("gray"))


def speckle(cells: DataFrame, plan: list[str], width: int, height: int, stride: int = 2) -> DataFrame:
    """(plan..., speckle): the share of ink pixels without ink beside, above or below them, of those on every stride-th row and column from 1 on, the border left out; 0 where there are none. cells: y, x of ink."""
    row, col = W.partitionBy(*plan, "y").orderBy("x"), W.partitionBy(*plan, "x").orderBy("y")
    near = lambda c, w: (F.coalesce(F.col(c) - F.lag(c).over(w) == 1, F.lit(False))) | (F.coalesce(F.lead(c).over(w) - F.col(c) == 1, F.lit(False)))
    alone = ~near("x", row) & ~near("y", col)
    looked = (F.col("x") % stride == 1) & (F.col("y") % stride == 1) & (F.col("x") < width - 1) & (F.col("y") < height - 1) if stride > 1 else F.lit(True)
    one = cells.select(*plan, "y", "x").withColumn("_a", alone.cast("int"))
    return one.groupBy(*plan).agg(F.coalesce(F.avg(F.when(looked, F.col("_a"))), F.lit(0.0)).alias("speckle"))
