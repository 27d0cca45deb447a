"""Walls in run tables: segments along the axes and what is left open in them, bridges that would close a hallway, networks around a missed point, the depth of
walls behind an outline, and how far an outline is supported.

Everything is a join or a window on a plan and a row, a column or a sample, so a large drawing is many tasks' work. runs: plan..., y, x0, x1 as in operators.raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import raster as R


def segments(runs: DataFrame, plan: list[str], work, direction: str, least: int, thickest: int, gap: int, tolerance: float) -> DataFrame:
    """(plan..., dir, center, lo, hi, drawn, thickness, parts): straight walls along rows (h) or columns (v).

    Runs of least pixels join up with those beside them; what is thicker than thickest is no wall. Walls whose middles are within a tolerance and which lie no more than gap apart
    are one, with the middle weighted by what is drawn. drawn counts the places along the wall that have ink.
    """
    along = runs if direction == "h" else R.transposed(runs, plan)
    long = along.filter(F.col("x1") - F.col("x0") + 1 >= least)
    part = work.save(R.components(long, plan, work, name=f"{direction}-"), f"{direction}-parts")
    covered = R.merged(part, [*plan, "root"]).groupBy(*plan, "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("drawn"))
    box = part.groupBy(*plan, "root").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.min("y").alias("a"), F.max("y").alias("b")).filter(F.col("b") - F.col("a") + 1 <= thickest)
    one = box.join(covered, [*plan, "root"]).select(*plan, "lo", "hi", "drawn", ((F.col("a") + F.col("b")) / 2).alias("c"), (F.col("b") - F.col("a") + 1).alias("t"), "root")
    by_center = W.partitionBy(*plan).orderBy("c", "lo", "root")
    apart = F.coalesce(F.col("c") - F.lag("c").over(by_center) > tolerance, F.lit(True)).cast("int")
    one = one.withColumn("_new", apart).withColumn("_line", F.sum("_new").over(by_center.rowsBetween(W.unboundedPreceding, 0)))
    by_place = W.partitionBy(*plan, "_line").orderBy("lo", "root")
    open_ = F.coalesce(F.col("lo") - F.max("hi").over(by_place.rowsBetween(W.unboundedPreceding, -1)) - 1 > gap, F.lit(True)).cast("int")
    one = one.withColumn("_open", open_).withColumn("_wall", F.sum("_open").over(by_place.rowsBetween(W.unboundedPreceding, 0)))
    return one.groupBy(*plan, "_line", "_wall").agg(
        F.lit(direction).alias("dir"), (F.sum(F.col("c") * F.col("drawn")) / F.sum("drawn")).alias("center"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("drawn").alias("drawn"), F.max("t").alias("thickness"), F.count("*").alias("parts")
    ).drop("_line", "_wall")


def bridged_span(walls: DataFrame, plan: list[str]) -> DataFrame:
    """(plan..., total, longest): what is open along walls, together, and the longest mean gap of one."""
    rest = F.col("hi") - F.col("lo") + 1 - F.col("drawn")
    return walls.groupBy(*plan).agg(F.sum(rest).alias("total"), F.max(F.when(F.col("parts") > 1, rest / (F.col("parts") - 1)).otherwise(F.lit(0.0))).alias("longest"))


def painted(walls: DataFrame, plan: list[str]) -> DataFrame:
    """The walls at full length as runs: openings in them are closed."""
    top = F.ceil(F.col("center") - (F.col("thickness") - 1) / 2)
    line = walls.select(*plan, "dir", "lo", "hi", F.explode(F.sequence(top, top + F.col("thickness") - 1)).alias("l"))
    across = line.filter("dir = 'h'").select(*plan, F.col("l").alias("y"), F.col("lo").alias("x0"), F.col("hi").alias("x1"))
    down = line.filter("dir = 'v'").select(*plan, F.explode(F.sequence("lo", "hi")).alias("y"), F.col("l").alias("x0"), F.col("l").alias("x1"))
    return R.merged(across.unionByName(down), [*plan, "y"])


def guarded_bridges(runs: DataFrame, plan: list[str], gap: int, flank: int, depth: int) -> DataFrame:
    """The gaps of R.bridges() but those at whose both ends a wall of 0.6 of a depth goes off to one side: such a gap is the mouth of a recess, not an opening in a wall."""
    hole = R.bridges(runs, plan, gap, flank)
    upright = R.transposed(runs, plan).select(*plan, F.col("y").alias("col"), F.col("x0").alias("top"), F.col("x1").alias("end"))

    def side(at: Column, name: str) -> DataFrame:
        met = hole.withColumn("col", at).join(upright, [*plan, "col"]).filter(F.col("y").between(F.col("top"), F.col("end")))
        return met.select(*plan, "y", "x0", "x1", (F.col("y") - F.col("top") >= 0.6 * depth).alias(f"{name}_up"), (F.col("end") - F.col("y") >= 0.6 * depth).alias(f"{name}_down"))

    key = [*plan, "y", "x0", "x1"]
    mouth = side(F.col("x0") - 1, "a").join(side(F.col("x1") + 1, "b"), key).filter("(a_up AND b_up) OR (a_down AND b_down)")
    return hole.join(mouth, key, "left_anti")


def _nearest(points: DataFrame, runs: DataFrame, line: str, at: str) -> DataFrame:
    """(plan_id, point_id, before, after): the nearest ink on both sides along a line; the run that a point is on is passed over."""
    met = points.select("plan_id", "point_id", F.col(line).alias("y"), F.col(at).alias("_at")).join(R.large(runs.select("plan_id", "y", "x0", "x1")), ["plan_id", "y"], "left")
    return met.groupBy("plan_id", "point_id").agg(F.max(F.when(F.col("x1") < F.col("_at"), F.col("x1"))).alias("before"), F.min(F.when(F.col("x0") > F.col("_at"), F.col("x0"))).alias("after"))


def implicated(points: DataFrame, runs: DataFrame, nets: DataFrame, pad: int) -> DataFrame:
    """(plan_id, point_id, net): the networks around a point that an outline missed: those that reach into the extent of what rays to four sides hit, where three hit.

    points: plan_id, point_id, x, y. nets: plan_id, net, x0, y0, x1, y1. A side without a hit reaches pad from the point.
    """
    rows = _nearest(points, runs, "y", "x").select("plan_id", "point_id", F.col("before").alias("l"), F.col("after").alias("r"))
    cols = _nearest(points, R.transposed(runs, ["plan_id"]), "x", "y").select("plan_id", "point_id", F.col("before").alias("t"), F.col("after").alias("b"))
    hit = points.join(R.large(rows), ["plan_id", "point_id"]).join(R.large(cols), ["plan_id", "point_id"])
    hit = hit.filter(sum(F.col(c).isNotNull().cast("int") for c in "lrtb") >= 3)
    ext = hit.select(
        "plan_id", "point_id", F.coalesce("l", F.col("x") - pad).alias("l"), F.coalesce("r", F.col("x") + pad).alias("r"), F.coalesce("t", F.col("y") - pad).alias("t"), F.coalesce("b", F.col("y") + pad).alias("b")
    )
    return ext.join(R.large(nets), "plan_id").filter("x0 <= r AND x1 >= l AND y0 <= b AND y1 >= t").select("plan_id", "point_id", "net")


def joins(around: DataFrame, nets: DataFrame, work) -> DataFrame:
    """(plan_id, root, nets): the networks to trace as one: those that stand around a missed point together, and with them those around others that share one. A group in which two or more close by themselves is left alone.

    around: plan_id, point_id, net. nets: plan_id, net, seals.
    """
    first = around.groupBy("plan_id", "point_id").agg(F.min("net").alias("u"))
    edge = around.join(R.large(first), ["plan_id", "point_id"]).filter("u != net").select("plan_id", "u", F.col("net").alias("v")).distinct()
    node = around.select("plan_id", F.col("net").alias("id")).distinct()
    told = R.connected(node, edge, ["plan_id"], work, "joins-")
    group = told.withColumnRenamed("id", "net").join(R.large(nets.select("plan_id", "net", "seals")), ["plan_id", "net"])
    one = group.groupBy("plan_id", "root").agg(F.sort_array(F.collect_set("net")).alias("nets"), F.sum(F.col("seals").cast("int")).alias("_s"))
    return one.filter("size(nets) > 1 AND _s < 2").drop("_s")


def joined(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(plan_id, root, y, x0, x1): the ink of each group's networks and, in their extent, that which belongs to none. runs: plan_id, y, x0, x1, net or null."""
    member = groups.select("plan_id", "root", F.explode("nets").alias("net"))
    own = runs.join(R.large(member), ["plan_id", "net"]).select("plan_id", "root", "y", "x0", "x1")
    box = own.groupBy("plan_id", "root").agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))
    free = runs.filter("net IS NULL").join(R.large(box), "plan_id").filter("y BETWEEN by0 AND by1 AND x0 >= bx0 AND x1 <= bx1").select("plan_id", "root", "y", "x0", "x1")
    return R.merged(own.unionByName(free), ["plan_id", "root", "y"])


def samples(rings: DataFrame, step: float, margin: float = 0.0) -> DataFrame:
    """(plan_id, floor, e, i, x, y, nx, ny, length): places along the edges of rings, step apart from the margin on; n is the normal that points inwards."""
    side = F.when(geom.signed_area(F.col("ring")) >= 0, 1.0).otherwise(-1.0)
    edge = rings.withColumn("_side", side).select("plan_id", "floor", "_side", F.explode(geom.edges(F.col("ring"))).alias("g"))
    edge = edge.select("plan_id", "floor", "_side", F.col("g.i").alias("e"), F.col("g.a").alias("a"), F.col("g.b").alias("b")).withColumn("length", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))).filter("length > 0")
    n = F.floor((F.col("length") - 2 * margin) / step).cast("int")
    at = edge.withColumn("i", F.explode(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))))
    t = F.lit(margin) + F.col("i") * step  # by the direction, which is a whole number along the axes: places there are exact
    ux, uy = (F.col("b.x") - F.col("a.x")) / F.col("length"), (F.col("b.y") - F.col("a.y")) / F.col("length")
    return at.select("plan_id", "floor", "e", "i", (F.col("a.x") + t * ux).alias("x"), (F.col("a.y") + t * uy).alias("y"), (-uy * F.col("_side")).alias("nx"), (ux * F.col("_side")).alias("ny"), "length")


def depths(at: DataFrame, runs: DataFrame, deepest: int, slack: int = 2) -> DataFrame:
    """at with depth: how many pixels of wall lie behind each sample, inwards along its normal, up to the first gap of more than slack."""
    ray = at.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    pixel = ray.withColumns({"px": F.floor(F.col("x") + (F.col("d") + 0.5) * F.col("nx")).cast("bigint"), "py": F.floor(F.col("y") + (F.col("d") + 0.5) * F.col("ny")).cast("bigint")})
    ink = runs.select("plan_id", F.col("y").cast("bigint").alias("py"), F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    key = ["plan_id", "floor", "e", "i"]
    hit = pixel.join(R.large(ink), ["plan_id", "py"]).filter(F.col("px").between(F.col("r0"), F.col("r1"))).select(*key, "d").distinct()
    before = F.coalesce(F.lag("d").over(W.partitionBy(*key).orderBy("d")), F.lit(-1))
    order = W.partitionBy(*key).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    solid = hit.withColumn("_gap", (F.col("d") - before - 1 > slack).cast("int")).withColumn("_cut", F.sum("_gap").over(order)).filter("_cut = 0")
    return at.join(R.large(solid.groupBy(*key).agg((F.max("d") + 1).alias("depth"))), key, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def upper_middle(value: str) -> Column:
    """The aggregate that is the upper median."""
    return F.element_at(F.sort_array(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def thickness(deep: DataFrame, stroke: float, least: int = 8) -> DataFrame:
    """(plan_id, floor, thickness): the upper median depth of the samples that have any, or the stroke where they are fewer than least."""
    own = deep.filter("depth > 0").groupBy("plan_id", "floor").agg(upper_middle("depth").alias("m"), F.count("*").alias("n"))
    return deep.select("plan_id", "floor").distinct().join(R.large(own), ["plan_id", "floor"], "left").select("plan_id", "floor", F.when(F.col("n") >= least, F.col("m")).otherwise(F.lit(stroke)).cast("double").alias("thickness"))


def insets(deep: DataFrame, whole: DataFrame, least: int = 3) -> DataFrame:
    """(plan_id, floor, e, inset, samples): the upper median depth behind each edge, or the whole ring's where fewer than least samples have one."""
    own = deep.groupBy("plan_id", "floor", "e").agg(upper_middle("depth").alias("m"), F.count_if(F.col("depth") > 0).alias("samples"))
    return own.join(R.large(whole), ["plan_id", "floor"]).select("plan_id", "floor", "e", F.when(F.col("samples") >= least, F.col("m").cast("double")).otherwise(F.col("thickness")).alias("inset"), "samples")


def inner_faces(rings: DataFrame, edges: DataFrame, whole: DataFrame) -> DataFrame:
    """(plan_id, floor, inner): rings with every edge moved inwards by its inset; edges that had no sample move by the whole ring's thickness."""
    per = edges.groupBy("plan_id", "floor").agg(F.map_from_entries(F.collect_list(F.struct("e", "inset"))).alias("m"))
    one = rings.join(R.large(whole), ["plan_id", "floor"]).join(R.large(per), ["plan_id", "floor"], "left")
    by = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.col("thickness")))
    return one.select("plan_id", "floor", geom.moved_in(F.col("ring"), by).alias("inner"))


def evidence(at: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """at with ink: whether there is ink within reach of each sample, along rows and columns."""
    near = at.withColumn("py", F.explode(F.sequence(F.floor("y").cast("bigint") - reach, F.floor("y").cast("bigint") + reach)))
    ink = runs.select("plan_id", F.col("y").cast("bigint").alias("py"), F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    key = ["plan_id", "floor", "e", "i"]
    hit = near.join(R.large(ink), ["plan_id", "py"]).filter((F.col("r0") <= F.floor("x") + reach) & (F.col("r1") >= F.floor("x") - reach)).select(*key).distinct().withColumn("ink", F.lit(True))
    return at.join(R.large(hit), key, "left").withColumn("ink", F.coalesce("ink", F.lit(False)))


# How far ink of each kind speaks for a wall.
GRADES = {"thick": 1.0, "wall": 0.45, "asserted": 0.45, "ink": 0.2}


def graded(at: DataFrame, masks: dict[str, DataFrame], reach: int) -> DataFrame:
    """at with level and kind: the best grade of ink within reach of each sample, along rows and columns: thick, wall, asserted (drawn by hand) or plain ink, in this order; 0 and null where there is none.
    masks: runs by kind. Positions are rounded, halves up."""
    x, y = F.floor(F.col("x") + 0.5).cast("bigint"), F.floor(F.col("y") + 0.5).cast("bigint")
    near = at.withColumns({"_x": x, "py": F.explode(F.sequence(y - reach, y + reach))})
    all_ = None
    for place, kind in enumerate(GRADES):
        if kind in masks:
            one = masks[kind].select("plan_id", F.col("y").cast("bigint").alias("py"), F.col("x0").alias("r0"), F.col("x1").alias("r1"), F.lit(place).alias("_k"))
            all_ = one if all_ is None else all_.unionByName(one)
    key = ["plan_id", "floor", "e", "i"]
    if all_ is None:
        return at.withColumns({"level": F.lit(0.0), "kind": F.lit(None).cast("string")})
    best = near.join(all_, ["plan_id", "py"]).filter((F.col("r0") <= F.col("_x") + reach) & (F.col("r1") >= F.col("_x") - reach)).groupBy(*key).agg(F.min("_k").alias("_k"))
    names, grades = F.array(*[F.lit(k) for k in GRADES]), F.array(*[F.lit(g) for g in GRADES.values()])
    return at.join(best, key, "left").withColumns({"level": F.coalesce(F.get(grades, F.col("_k")), F.lit(0.0)), "kind": F.get(names, F.col("_k"))}).drop("_k")


def graded_support(level: DataFrame) -> DataFrame:
    """(plan_id, floor, mean, bare, longest): the mean grade along an outline, by the length that each sample stands for, the share without any, and the longest stretch without, in the
    order of edges from the first on. level: from graded(), with step, that length."""
    order = W.partitionBy("plan_id", "floor").orderBy("e", "i").rowsBetween(W.unboundedPreceding, 0)
    one = level.withColumn("_g", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(order))
    gap = one.filter("level <= 0").groupBy("plan_id", "floor", "_g").agg(F.sum("step").alias("n")).groupBy("plan_id", "floor").agg(F.max("n").alias("longest"))
    share = level.groupBy("plan_id", "floor").agg((F.sum(F.col("level") * F.col("step")) / F.sum("step")).alias("mean"), (F.sum(F.when(F.col("level") <= 0, F.col("step")).otherwise(0.0)) / F.sum("step")).alias("bare"))
    return share.join(gap, ["plan_id", "floor"], "left").withColumn("longest", F.coalesce("longest", F.lit(0.0)))


def bare_stretches(judged: DataFrame, step: float, most: int = 6) -> DataFrame:
    """(plan_id, floor, n, length, x0, y0, x1, y1): the longest stretches of an outline without ink, most of them, with their boxes. A stretch that goes over the first vertex is one."""
    ring = W.partitionBy("plan_id", "floor").orderBy("e", "i")
    one = judged.withColumn("k", F.row_number().over(ring)).withColumn("all", F.count("*").over(W.partitionBy("plan_id", "floor")))
    bare = one.filter("NOT ink").withColumn("g", F.col("k") - F.row_number().over(ring))
    part = bare.groupBy("plan_id", "floor", "g", "all").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n"), *[f(c).alias(f"{c}{s}") for c in "xy" for f, s in ((F.min, 0), (F.max, 1))])
    # the last stretch and the first are one where they meet
    whole = W.partitionBy("plan_id", "floor")
    wraps = F.max(F.col("a") == 1).over(whole) & F.max(F.col("b") == F.col("all")).over(whole)
    part = part.withColumn("g", F.when(wraps & (F.col("b") == F.col("all")), F.lit(0)).when(wraps & (F.col("a") == 1), F.lit(0)).otherwise(F.col("a")))
    run = part.groupBy("plan_id", "floor", "g").agg(F.sum("n").alias("n"), *[f(f"{c}{s}").alias(f"{c}{s}") for c in "xy" for f, s in ((F.min, 0), (F.max, 1))])
    return run.withColumn("place", F.row_number().over(whole.orderBy(F.desc("n"), "g"))).filter(F.col("place") <= most).select("plan_id", "floor", "n", (F.col("n") * step).alias("length"), "x0", "y0", "x1", "y1")


def support(judged: DataFrame, step: float) -> DataFrame:
    """(plan_id, floor, mean, bare, longest): the share of an outline that has ink, the rest, and the longest stretch without."""
    longest = bare_stretches(judged, step, 1).select("plan_id", "floor", F.col("length").alias("longest"))
    share = judged.groupBy("plan_id", "floor").agg(F.avg(F.col("ink").cast("int")).alias("mean"))
    return share.join(R.large(longest), ["plan_id", "floor"], "left").select("plan_id", "floor", "mean", (1 - F.col("mean")).alias("bare"), F.coalesce("longest", F.lit(0.0)).alias("longest"))


def shared_ink(a: DataFrame, b: DataFrame, plan: list[str], weight: Column | None = None) -> DataFrame:
    """(plan..., shared, weighted): pixels that two masks have in common, and their sum by a weight of a's runs."""
    w = F.lit(1.0) if weight is None else weight
    both = a.withColumn("_w", w).join(R.large(b.select(*plan, "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"))), [*plan, "y"])
    n = F.greatest(F.least("x1", "_b") - F.greatest("x0", "_a") + 1, F.lit(0))
    return both.groupBy(*plan).agg(F.sum(n).alias("shared"), F.sum(n * F.col("_w")).alias("weighted"))


STRUCTURAL, THIN = 1.0, 0.25  # fixed values


def coverage(ink: DataFrame, mask: DataFrame, plan: list[str]) -> DataFrame:
    """(plan..., coverage): the share of wall ink inside a mask; thin ink counts a quarter. ink: plan..., y, x0, x1, thin."""
    weight = F.when(F.col("thin"), F.lit(THIN)).otherwise(F.lit(STRUCTURAL))
    whole = ink.groupBy(*plan).agg(F.sum((F.col("x1") - F.col("x0") + 1) * weight).alias("_all"))
    return whole.join(R.large(shared_ink(ink, mask, plan, weight)), plan, "left").select(*plan, F.when(F.col("_all") > 0, F.coalesce("weighted", F.lit(0.0)) / F.col("_all")).otherwise(F.lit(0.0)).alias("coverage"))


def excluded(widest: DataFrame, best: DataFrame, plan: list[str], least: float = 0.02) -> DataFrame:
    """(plan..., area, share): what the widest outline encloses beyond the best one, where that is least of the best or more."""
    size = lambda df, name: df.groupBy(*plan).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias(name))
    beyond = size(R.difference(widest, best, plan), "area").join(R.large(size(best, "_best")), plan)
    return beyond.withColumn("share", F.col("area") / F.col("_best")).filter(F.col("share") >= least).drop("_best")


def should_retry(confidence: Column, missed: Column, drawn: Column) -> Column:
    """Whether an outline is traced again: it misses known places or is unsure; one that was drawn by hand never is."""
    return ~F.coalesce(drawn, F.lit(False)) & ((F.coalesce(missed, F.lit(0)) > 0) | (confidence < 0.75))


def best_attempts(attempts: DataFrame) -> DataFrame:
    """(plan_id, round, held, effective): the attempt of each plan that stands in the end. Each is taken in turn only if it holds no fewer known places than the one that stands and is surer by a thousandth.

    attempts: plan_id, round, confidence, factor (of missed places), held. A plan's rounds are few.
    """
    one = attempts.withColumn("effective", F.col("confidence") * F.col("factor"))
    row = F.struct("round", "held", "effective")
    log = one.groupBy("plan_id").agg(F.sort_array(F.collect_list(row)).alias("log"))
    better = lambda now, x: (x["held"] >= now["held"]) & (x["effective"] > now["effective"] + 1e-3)
    last = F.aggregate(F.slice("log", F.lit(2), F.size("log")), F.get("log", F.lit(0)), lambda now, x: F.when(better(now, x), x).otherwise(now))
    return log.select("plan_id", last.alias("b")).select("plan_id", "b.round", "b.held", "b.effective")


def reading_order(floors: DataFrame) -> DataFrame:
    """floors with place, from 0: in rows from top to bottom, and from left to right in each. A floor belongs to the row above it if it shares over 0.3 of the lower one's height with what the row takes up so far.

    floors: plan_id, floor, x0, y0, x1, y1. A plan's floors are few: rows are formed by a fold over them.
    """
    one = F.struct("y0", "x0", "floor", "y1")
    per = floors.groupBy("plan_id").agg(F.sort_array(F.collect_list(one)).alias("f"))

    def step(s: Column, f: Column) -> Column:
        shared = F.least(s["y1"], f["y1"]) - F.greatest(s["y0"], f["y0"])
        same = (F.size(s["out"]) > 0) & (shared > 0.3 * F.least(s["y1"] - s["y0"], f["y1"] - f["y0"]))
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(
            F.when(same, F.least(s["y0"], f["y0"])).otherwise(f["y0"]).alias("y0"), F.when(same, F.greatest(s["y1"], f["y1"])).otherwise(f["y1"]).alias("y1"), row.alias("row"),
            F.concat(s["out"], F.array(F.struct(row.alias("row"), f["x0"].alias("x0"), f["floor"].alias("floor")))).alias("out"),
        )

    kind = f"array<struct<row:int,x0:double,floor:{floors.schema['floor'].dataType.simpleString()}>>"
    start = F.struct(F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"), F.lit(-1).alias("row"), F.array().cast(kind).alias("out"))
    rows = per.select("plan_id", F.sort_array(F.aggregate("f", start, step)["out"]).alias("o")).select("plan_id", F.posexplode("o").alias("place", "o"))
    return floors.join(rows.select("plan_id", F.col("o.floor").alias("floor"), F.col("place").cast("bigint").alias("place")), ["plan_id", "floor"])
