"""Tracing again where the first outline is known to be wrong: it leaves out places that are inside, or is unsure.

Outlines are footprints in run tables. An attempt closes every part of a plan's partition over a ladder of radii and keeps, for each part, the rung that closes best for the least closing. Where places
are left out, the networks around them are joined up and tried as one; where that doesn't help, the ladder is made twice as long, once. An attempt is taken only if
it holds no fewer known places and is surer by a thousandth. A plan goes on while attempts are taken and something is left to mend, for ROUNDS rounds and PASSES attempts at most. Only plans
that are still open are in the tables of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scale import constraint_factor
from plumbline.operators import editing, floods, walls
from plumbline.operators import raster as R

# Rounds, attempts, what is sure enough, by how much an attempt must be surer, what of a room must be covered.
ROUNDS, PASSES, SURE, SURER, COVER = 3, 4, 0.75, 1e-3, 0.9
LADDER, WIDE = (1, 2, 3), (1, 2, 3, 4, 6)  # closing radii in walls
PART = ["plan_id", "part"]


def attempt(parts: DataFrame, thickness: int, ladder: tuple[int, ...], work, name: str) -> tuple[DataFrame, DataFrame]:
    """((plan_id, part, radius, area, seal, confidence), (plan_id, part, y, x0, x1) footprints). Parts whose extent is less than a tenth of the plan's largest are no floors."""
    limits = floods.own_limits(parts, PART, thickness)
    most = F.max("box").over(W.partitionBy("plan_id"))
    limits = work.save(limits.withColumn("_m", most).filter("box >= 0.1 * _m").drop("_m"), f"{name}limits")
    ink = floods.bridged(parts.join(limits.select(*PART), PART, "left_semi"), PART, limits)
    radii = [thickness * k for k in ladder]
    rung = [*PART, "radius"]
    shut = work.save(floods.closed(ink.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii]))), rung, F.col("radius")), f"{name}shut")
    part = work.save(floods.parts(floods.enclosed(shut, rung, work, f"{name}in-"), rung, work, f"{name}of-"), f"{name}parts")
    own = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    each = floods.largest(part, rung).join(limits, PART).withColumn("seal", floods.seal(F.col("area"), own, F.col("box")))
    place = F.row_number().over(W.partitionBy(*PART).orderBy(F.desc(F.col("seal") - 0.1 * F.col("radius") / radii[-1]), "radius"))
    best = each.withColumn("_p", place).filter("_p = 1")
    heavy = F.when(F.col("radius") >= 0.6 * radii[-1], 0.85).otherwise(1.0)
    best = work.save(best.select(*rung, "root", "area", "seal", F.least(F.lit(0.98), F.col("seal") * heavy).alias("confidence")), f"{name}best")
    print_ = floods.rows_of(part.join(best.select(*rung, "root"), [*rung, "root"], "left_semi"), PART)
    return best.drop("root"), work.save(print_, f"{name}prints")


def held(prints: DataFrame, points: DataFrame, rooms: DataFrame) -> DataFrame:
    """(plan_id, point_id, x, y, held): the known places of the plans, points and middles of rooms, and whether a footprint holds each: a point by its pixel, a room by most of its area."""
    ink = R.merged(prints.select("plan_id", "y", "x0", "x1"), ["plan_id", "y"])
    pixel = points.select("plan_id", "point_id", F.floor(F.col("x") + 0.5).cast("bigint").alias("x"), F.floor(F.col("y") + 0.5).cast("bigint").alias("y"))
    hit = pixel.join(ink, ["plan_id", "y"]).filter(F.col("x").between(F.col("x0"), F.col("x1"))).select("plan_id", "point_id").withColumn("held", F.lit(True))
    one = pixel.join(hit, ["plan_id", "point_id"], "left").select("plan_id", "point_id", "x", "y", F.coalesce("held", F.lit(False)).alias("held"))
    middle = rooms.select("plan_id", F.col("rect_id").alias("point_id"), F.floor((F.col("x0") + F.col("x1")) / 2).cast("bigint").alias("x"), F.floor((F.col("y0") + F.col("y1")) / 2).cast("bigint").alias("y"))
    cover = editing.rect_coverage(rooms, ink).select("plan_id", F.col("rect_id").alias("point_id"), (F.col("cover") >= COVER).alias("held"))
    return one.unionByName(middle.join(cover, ["plan_id", "point_id"]))


def join_groups(missed: DataFrame, parts: DataFrame, loose: DataFrame, thickness: int, page: int, work, name: str) -> DataFrame:
    """(plan_id, part, root): the parts that stand around missed places together, by the least part of their group. Groups whose extents meet are one; a group of which two or
    more parts close by themselves is left alone: those are two drawings."""
    pad = max(8, 2 * thickness)
    ink = R.merged(parts.select("plan_id", "y", "x0", "x1").unionByName(loose.select("plan_id", "y", "x0", "x1")), ["plan_id", "y"])
    probe = work.save(R.bridged(ink, ["plan_id"], max(24, 12 * thickness, round(0.3 * page)), max(8, 2 * thickness)), f"{name}probe")
    box = work.save(floods.boxes(parts, PART), f"{name}boxes")
    nets = box.select("plan_id", F.col("part").alias("net"), (F.col("bx0") - pad).alias("x0"), (F.col("by0") - pad).alias("y0"), (F.col("bx1") + pad).alias("x1"), (F.col("by1") + pad).alias("y1"))
    around = walls.implicated(missed.select("plan_id", "point_id", "x", "y"), probe, nets, 0)
    several = W.partitionBy("plan_id", "point_id")
    around = work.save(around.withColumn("_n", F.count("*").over(several)).filter("_n > 1").select("plan_id", F.col("point_id").alias("id"), F.col("net").alias("part")), f"{name}around")
    group, turn, n = around.select("plan_id", "id", F.col("id").alias("root")).distinct(), 0, -1
    while True:  # extents grow when groups join up, and may meet others then
        extent = around.join(group, ["plan_id", "id"]).join(box, PART).groupBy("plan_id", "root").agg(F.min("bx0").alias("a0"), F.min("by0").alias("b0"), F.max("bx1").alias("a1"), F.max("by1").alias("b1"))
        extent = work.save(extent, f"{name}extent{turn}")
        before, n = n, extent.count()
        if n == before or not n:
            break
        turn += 1
        other = extent.select("plan_id", *[F.col(c).alias(f"_{c}") for c in ("root", "a0", "b0", "a1", "b1")])
        meet = extent.join(other, "plan_id").filter((F.col("root") < F.col("_root")) & (F.col("a0") <= F.col("_a1") + pad) & (F.col("_a0") <= F.col("a1") + pad) & (F.col("b0") <= F.col("_b1") + pad) & (F.col("_b0") <= F.col("b1") + pad))
        whole = R.connected(extent.select("plan_id", F.col("root").alias("id")), meet.select("plan_id", F.col("root").alias("u"), F.col("_root").alias("v")), ["plan_id"], work, f"{name}meet{turn}-")
        group = work.save(group.join(whole.select("plan_id", F.col("id").alias("root"), F.col("root").alias("_new")), ["plan_id", "root"]).select("plan_id", "id", F.col("_new").alias("root")), f"{name}group{turn}")
    member = work.save(around.join(group, ["plan_id", "id"]).select("plan_id", "part", F.col("root").alias("g")).distinct(), f"{name}members")
    alone = floods.self_seals(parts.join(member.select(*PART), PART, "left_semi"), PART, thickness, work, f"{name}alone-")
    judged = member.join(alone.select(*PART, F.col("seals").cast("int").alias("s")), PART, "left")
    fit = judged.groupBy("plan_id", "g").agg(F.sum(F.coalesce("s", F.lit(0))).alias("s"), F.min("part").alias("root")).filter("s < 2")
    return member.join(fit, ["plan_id", "g"]).select("plan_id", "part", "root")


def joined(parts: DataFrame, loose: DataFrame, groups: DataFrame, pad: int) -> DataFrame:
    """parts with each group as one part, with the loose ink in its extent; the other parts stay."""
    named = parts.join(groups, PART, "left").select("plan_id", F.coalesce("root", "part").alias("part"), "y", "x0", "x1", F.col("root").isNotNull().alias("new"))
    box = floods.boxes(named.filter("new"), PART, pad)
    free = loose.select("plan_id", "y", "x0", "x1").join(box, "plan_id").filter("y BETWEEN by0 AND by1 AND x0 >= bx0 AND x1 <= bx1").select(*PART, "y", "x0", "x1")
    return R.merged(named.select(*PART, "y", "x0", "x1").unionByName(free), [*PART, "y"])


def retrace(nets: DataFrame, points: DataFrame, rooms: DataFrame, thickness: int, page: int, work) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, log, prints) of plans. nets: plan_id, net or null for loose ink, y, x0, x1. points: plan_id, point_id, x, y. rooms: plan_id, rect_id (no point_id), x0, y0, x1, y1. page: the longer side.

    state: plan_id, how (base, join or escalate), confidence, effective, held, total, before (held at first), tried. log has a row for each attempt that was made: plan_id, round, how,
    confidence, effective, held, total, accepted; round 0 is the first one. prints: the footprints that stand: plan_id, part, y, x0, x1.
    """
    loose = work.save(nets.filter("net IS NULL").select("plan_id", "y", "x0", "x1"), "loose")
    parts = work.save(nets.filter("net IS NOT NULL").select("plan_id", F.col("net").alias("part"), "y", "x0", "x1"), "parts-0")
    none = work.save(points.limit(0).select("plan_id"), "none")

    def tried(part: DataFrame, ladder: tuple[int, ...], how: str, name: str):
        """(plan_id, how, confidence, effective, held, total), the missed places, footprints and the partition, of an attempt."""
        floors, prints = attempt(part, thickness, ladder, work, name)
        plans = part.select("plan_id").distinct()
        places = work.save(held(prints, points.join(plans, "plan_id", "left_semi"), rooms.join(plans, "plan_id", "left_semi")), f"{name}places")
        n = places.groupBy("plan_id").agg(F.count_if("held").alias("held"), F.count("*").alias("total"))
        worst = floors.groupBy("plan_id").agg(F.min("confidence").alias("confidence"))
        zero = F.lit(0).cast("bigint")
        row = plans.join(worst, "plan_id", "left").join(n, "plan_id", "left").select("plan_id", F.lit(how).alias("how"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("held", zero).alias("held"), F.coalesce("total", zero).alias("total"))
        row = row.withColumn("effective", F.col("confidence") * constraint_factor(F.col("total") - F.col("held"), F.col("total"), F.lit(False)))
        return work.save(row, f"{name}row"), places.filter("NOT held"), prints, part

    def accepted(row: DataFrame, state: DataFrame) -> DataFrame:
        now = state.select("plan_id", F.col("held").alias("_h"), F.col("effective").alias("_e"))
        return row.join(now, "plan_id").filter((F.col("held") >= F.col("_h")) & (F.col("effective") > F.col("_e") + SURER)).drop("_h", "_e")

    def swapped(old: DataFrame, new: DataFrame, plans: DataFrame) -> DataFrame:
        return old.join(plans, "plan_id", "left_anti").unionByName(new.join(plans, "plan_id", "left_semi").select(*old.columns))

    row, missed, prints, _ = tried(parts, LADDER, "base", "base-")
    log = [row.select("plan_id", F.lit(0).alias("round"), "how", "confidence", "effective", "held", "total", F.lit(True).alias("accepted"))]
    unsure = (F.col("held") < F.col("total")) | (F.col("confidence") < SURE)
    state = work.save(row.withColumns({"before": F.col("held"), "tried": F.lit(0), "escalated": F.lit(False), "open": unsure}), "state-0")
    for k in range(1, ROUNDS + 1):
        todo = work.save(state.filter(F.col("open") & (F.col("tried") < PASSES)), f"todo-{k}")
        if todo.isEmpty():
            break
        of = lambda df: df.join(todo.select("plan_id"), "plan_id", "left_semi")  # noqa: E731, B023
        groups = work.save(join_groups(of(missed), of(parts), of(loose), thickness, page, work, f"join{k}-"), f"groups-{k}")
        taken, made = [], []
        if not groups.isEmpty():
            some = groups.select("plan_id").distinct()
            one = work.save(joined(parts.join(some, "plan_id", "left_semi"), loose.join(some, "plan_id", "left_semi"), groups, max(8, 2 * thickness)), f"joined-{k}")
            made.append(tried(one, LADDER, "join", f"try{k}-"))
            taken.append(work.save(accepted(made[0][0], state), f"taken{k}-join"))
        rest = todo.filter(~F.col("escalated") & (F.col("tried") < PASSES - len(made))).select("plan_id")
        rest = work.save(rest.join(taken[0].select("plan_id") if taken else none, "plan_id", "left_anti"), f"rest-{k}")
        if not rest.isEmpty():
            wide = parts.join(rest, "plan_id", "left_semi")
            made.append(tried(wide, WIDE, "escalate", f"wide{k}-"))
            taken.append(work.save(accepted(made[-1][0], state), f"taken{k}-wide"))
        if not made:
            break
        for (row, left, print_, part), t in zip(made, taken):
            plans = t.select("plan_id")
            log.append(row.join(plans.withColumn("accepted", F.lit(True)), "plan_id", "left").select("plan_id", F.lit(k).alias("round"), "how", "confidence", "effective", "held", "total", F.coalesce("accepted", F.lit(False)).alias("accepted")))
            missed, prints, parts = swapped(missed, left, plans), swapped(prints, print_, plans), swapped(parts, part, plans)
        missed, prints, parts = (work.save(df, f"{n}-{k}") for df, n in ((missed, "missed"), (prints, "standing"), (parts, "parts")))
        new = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
        went = [r[0].groupBy("plan_id").agg(F.count("*").alias("_n"), F.bool_or(F.col("how") == "escalate").alias("_x")) for r in made]
        went = (went[0] if len(went) == 1 else went[0].unionByName(went[1])).groupBy("plan_id").agg(F.sum("_n").cast("int").alias("_n"), F.bool_or("_x").alias("_x"))
        then = new.select("plan_id", F.col("how").alias("_how"), F.col("confidence").alias("_c"), F.col("effective").alias("_e"), F.col("held").alias("_h"))
        both = state.join(went, "plan_id", "left").join(then, "plan_id", "left")
        now = lambda a, b: F.coalesce(a, b)
        state = both.select(
            "plan_id", now("_how", "how").alias("how"), now("_c", "confidence").alias("confidence"), now("_h", "held").alias("held"), "total", now("_e", "effective").alias("effective"), "before",
            (F.col("tried") + now("_n", F.lit(0))).alias("tried"), (F.col("escalated") | now("_x", F.lit(False))).alias("escalated"),
            (F.col("_how").isNotNull() & ((now("_h", "held") < F.col("total")) | (now("_c", "confidence") < SURE))).alias("open"),
        )
        state = work.save(state, f"state-{k}")
    whole = log[0]
    for more in log[1:]:
        whole = whole.unionByName(more)
    return state.drop("escalated", "open"), whole, prints
