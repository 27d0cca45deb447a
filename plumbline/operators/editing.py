"""What edits and results do to the tables of outlines: verdicts, faces, patches, targets of clicks, and the evidence that constraints give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geom, labels
from plumbline.operators import spatial


def apply_verdicts(outlines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """outlines with new_type: a verdict's type, or the default where the evidence has gone; types that a user set stay. outlines: plan_id, trace_id, type, type_source. verdicts: plan_id, trace_id, type."""
    v = verdicts.select("plan_id", "trace_id", F.col("type").alias("verdict"))
    kept = labels.normal_type(F.col("type"))
    return outlines.join(v, ["plan_id", "trace_id"], "left").withColumn("new_type", F.when(F.col("type_source") == "user", kept).otherwise(F.coalesce("verdict", F.lit(labels.DEFAULT_TYPE)))).drop("verdict")


def replace_outlines(held: DataFrame, new: DataFrame) -> DataFrame:
    """(plan_id, ord, trace_id, ring): new rings; where a plan has as many outlines as before, the one of the same place keeps its id. held: plan_id, ord, trace_id. new: plan_id, ord, new_id, ring."""
    n = lambda df, c: df.withColumn(c, F.count("*").over(W.partitionBy("plan_id")))
    both = n(new, "nn").join(n(held, "nh").select("plan_id", "ord", "trace_id", "nh"), ["plan_id", "ord"], "left")
    return both.select("plan_id", "ord", F.when(F.col("nn") == F.col("nh"), F.col("trace_id")).otherwise(F.col("new_id")).alias("trace_id"), "ring")


def face_of(outer: Column, inner: Column, interior: bool) -> Column:
    """The face that a mode asks for, or the other where that is missing."""
    return F.coalesce(inner, outer) if interior else F.coalesce(outer, inner)


def merge_holes(held: Column, new: Column) -> Column:
    """The user's holes, and the new ones."""
    return F.concat(F.filter(F.coalesce(held, F.array().cast(_HOLES)), lambda h: h["source"] == "user"), F.coalesce(new, F.array().cast(_HOLES)))


_HOLES = "array<struct<id:string,ring:array<struct<x:double,y:double>>,source:string,stale:boolean>>"


def patched(old: Column, present: Column, new: Column, absent: str = "keep") -> Column:
    """A field after a patch: the new value where the patch has the field, null or not; else the old one, or null."""
    return F.when(present, new).when(F.lit(absent == "keep"), old)


def target_outline(outlines: DataFrame, rings: DataFrame) -> DataFrame:
    """(plan_id, ring_id, trace_id): the outline around the centre of each ring, the active one before others, then the smallest, then the least id.

    outlines: plan_id, trace_id, ring, active. rings: plan_id, ring_id, hole.
    """
    at = rings.select("plan_id", "ring_id", geom.let(geom.centroid(F.col("hole")), lambda c: geom.box(c["x"], c["y"], c["x"], c["y"])).alias("box"))
    near = spatial.meeting(at, outlines.withColumn("box", geom.bounds(F.col("ring"))), spatial.WIDE)
    pair = near.select("a.plan_id", "a.ring_id", "a.box", "b.trace_id", "b.ring", "b.active").filter(geom.in_ring(geom.point(F.col("box.x0"), F.col("box.y0")), F.col("ring")))
    best = pair.groupBy("plan_id", "ring_id").agg(F.min(F.struct((~F.col("active")).alias("a"), geom.ring_area(F.col("ring")).alias("s"), "trace_id")).alias("b"))
    return best.select("plan_id", "ring_id", "b.trace_id")


def nearest_vertex(points: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """(plan_id, point_id, i): the vertex nearest to each point within a reach; of equal ones the first. points: plan_id, point_id, x, y. vertices: plan_id, i, vx, vy."""
    gap = F.hypot(F.col("x") - F.col("vx"), F.col("y") - F.col("vy"))
    close = points.join(vertices, "plan_id").filter((F.abs(F.col("x") - F.col("vx")) <= reach) & (F.abs(F.col("y") - F.col("vy")) <= reach)).withColumn("gap", gap).filter(F.col("gap") <= reach)
    return close.groupBy("plan_id", "point_id").agg(F.min(F.struct("gap", "i")).alias("b")).select("plan_id", "point_id", "b.i")


def rect_coverage(rects: DataFrame, runs: DataFrame, steps: int = 24) -> DataFrame:
    """(plan_id, rect_id, cover): the share of a rectangle's sample points, some steps apart on each side, that are ink. rects: plan_id, rect_id, x0, y0, x1, y1. runs: plan_id, y, x0, x1."""
    step = lambda a, b: F.greatest(F.lit(1), F.floor((F.col(b) - F.col(a)) / steps + 0.5)).cast("bigint")
    rows = rects.filter("x1 >= x0 AND y1 >= y0").withColumns({"sx": step("x0", "x1"), "y": F.explode(F.sequence("y0", "y1", step("y0", "y1")))})
    points = rows.select("plan_id", "rect_id", "y", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), "sx")
    # multiples of the step from rx0 inside a run, counted rather than listed
    hit = points.join(runs.withColumnRenamed("x0", "a").withColumnRenamed("x1", "b"), ["plan_id", "y"], "left")
    lo, hi = F.greatest("a", "rx0") - F.col("rx0"), F.least("b", "rx1") - F.col("rx0")
    n = F.when(F.col("a").isNotNull() & (hi >= lo), F.floor(hi / F.col("sx")) - F.floor((lo - 1) / F.col("sx"))).otherwise(F.lit(0))
    row = hit.groupBy("plan_id", "rect_id", "y").agg(F.sum(n).alias("ink"), F.first(F.floor((F.col("rx1") - F.col("rx0")) / F.col("sx")) + 1).alias("all"))
    cover = row.groupBy("plan_id", "rect_id").agg((F.sum("ink") / F.sum("all")).alias("cover"))
    return rects.select("plan_id", "rect_id").join(cover, ["plan_id", "rect_id"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0)))


def constraints_held(covers: DataFrame, least: float = 0.9) -> DataFrame:
    """(plan_id, held, total, fit): how many rooms an outline covers well enough."""
    ok = (F.col("cover") >= least).cast("bigint")
    return covers.groupBy("plan_id").agg(F.sum(ok).alias("held"), F.count("*").alias("total"), F.avg(ok).alias("fit"))


def cavity_vote(rects: DataFrame, runs: DataFrame) -> DataFrame:
    """(plan_id, rect_id, root): the component that most of a 5 by 5 grid of points in each rectangle lies in; of equal ones the least. runs: with root."""
    grid = F.array(*[F.lit((k + 0.5) / 5) for k in range(5)])
    at = rects.withColumn("fx", F.explode(grid)).withColumn("fy", F.explode(grid))
    at = at.select("plan_id", "rect_id", F.floor(F.col("x0") + F.col("fx") * (F.col("x1") - F.col("x0") + 1)).alias("x"), F.floor(F.col("y0") + F.col("fy") * (F.col("y1") - F.col("y0") + 1)).alias("y"))
    hit = at.join(runs.withColumnRenamed("x0", "a").withColumnRenamed("x1", "b"), ["plan_id", "y"]).filter(F.col("x").between(F.col("a"), F.col("b")))
    n = hit.groupBy("plan_id", "rect_id", "root").agg(F.count("*").alias("n"))
    return n.groupBy("plan_id", "rect_id").agg(F.max(F.struct("n", (-F.col("root")).alias("r"))).alias("b")).select("plan_id", "rect_id", (-F.col("b.r")).alias("root"))


def capped_history(stacks: DataFrame, most: int = 50) -> DataFrame:
    """The entries that are kept of a saved history: the newest of both stacks together, undo before redo. stacks: doc_id, stack, seq."""
    order = W.partitionBy("doc_id").orderBy(F.when(F.col("stack") == "undo", 0).otherwise(1), F.desc("seq"))
    return stacks.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def scale_update(dims: DataFrame) -> DataFrame:
    """dims with sx, sy, level, source, changed: what measuring a room does to the plan's scale.

    dims: dw, dh, bw, bh, others (samples), pinned, source_now, sx_now, sy_now, level_now. A scale that the user set stays theirs: it is judged against the others, but only flagged.
    """
    from plumbline.functions import scale as S

    pinned = F.col("pinned") | S.user_asserted(F.col("source_now"))
    one = dims.withColumn("_pinned", pinned).withColumn("_d", S.decide(F.col("dw"), F.col("dh"), F.col("bw"), F.col("bh"), F.when(pinned, F.array().cast("array<double>")).otherwise(F.col("others"))))
    gap = geom.let(S.robust(F.col("others")), lambda r: S.log_gap(F.col("_d.room_scale"), r["value"]))
    one = one.withColumn("_gap", F.when(F.col("_pinned") & (F.size("others") >= 2), gap))
    level = F.when(F.col("_gap") > S.PLAN_SPREAD, "check").when(F.col("_gap") > S.ROOM_GAP, "note").otherwise(F.col("_d.level"))
    source = F.when(F.col("_d.adopted"), "manual").otherwise("auto")
    moved = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > 1e-9, F.lit(True))
    out = one.withColumns({"sx": F.col("_d.x"), "sy": F.col("_d.y"), "level": level, "source": source})
    changed = moved("sx", "sx_now") | moved("sy", "sy_now") | ~F.col("level").eqNullSafe(F.coalesce("level_now", F.lit("ok"))) | ~F.col("source").eqNullSafe(F.col("source_now"))
    return out.withColumn("changed", changed).drop("_pinned", "_d", "_gap")
