"""A plan's scale from all its rooms, and from lines drawn on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geom, labels
from plumbline.functions import scale as S
from plumbline.operators import raster as R


def select_scale(rooms: DataFrame, footprints: DataFrame) -> DataFrame:
    """(plan_id, ppf, level, reason, room_count, spread, area_ratio, rejected): the consensus of a plan's rooms and how far it holds.

    rooms: plan_id, name, px, py (pixels per foot of the axes), confidence, dim_w, dim_h, outside (whether a non-living label covers it). footprints:
    plan_id, area_px. A room counts if both axes are known, it is of the living area and found with enough confidence; an axis counts if it is near the median.
    """
    out = F.coalesce("outside", F.lit(False)) | labels.exterior_feature(F.coalesce("name", F.lit(""))).isNotNull()
    good = (F.col("px") > 0) & (F.col("py") > 0) & ~out & (F.col("confidence") >= S.CONFIDENCE_FLOOR)
    good = F.coalesce(good, F.lit(False))
    sized = F.coalesce((F.col("dim_w") > 0) & (F.col("dim_h") > 0) & ~out, F.lit(False))
    plan = rooms.groupBy("plan_id").agg(
        F.collect_list(F.when(good, F.struct("px", "py"))).alias("rooms"), F.count("*").alias("all"), F.coalesce(F.sum(F.when(sized, F.col("dim_w") * F.col("dim_h"))), F.lit(0.0)).alias("label_sqft")
    )
    samples = F.flatten(F.transform("rooms", lambda r: F.array(r["px"], r["py"])))
    plan = plan.withColumn("samples", samples).withColumn("robust", S.robust(F.col("samples")))
    near = lambda v: S.log_gap(v, F.col("robust.median")) <= S.KEEP
    plan = plan.withColumns({
        "kept": F.filter("samples", near),
        "room_count": F.size(F.filter("rooms", lambda r: near(r["px"]) | near(r["py"]))).cast("bigint"),
    })
    plan = plan.withColumn("spread", F.when(F.size("kept") > 1, F.ln(F.array_max("kept") / F.array_min("kept"))).otherwise(F.lit(0.0))).join(R.large(footprints), "plan_id", "left")
    foot = F.when(F.col("area_px") > 0, F.col("area_px") / (F.col("robust.value") * F.col("robust.value")))
    plan = plan.withColumn("area_ratio", F.when((foot > 0) & (F.col("label_sqft") > 0), foot / F.col("label_sqft")))
    none = F.col("robust").isNull()
    reason = (
        F.when(none, F.lit("no-rooms"))
        .when(F.col("area_ratio") < S.FOOTPRINT_TO_LABELS, F.lit("area-implausible"))
        .when(F.col("spread") > S.SPREAD_LIMIT, F.lit("rooms-disagree"))
        .when(F.col("room_count") < S.MIN_ROOMS, F.lit("too-few-rooms"))
        .otherwise(F.lit("auto-consensus"))
    )
    return plan.select(
        "plan_id",
        F.col("robust.value").alias("ppf"),
        F.when(reason == "auto-consensus", F.lit("ok")).otherwise(F.lit("check")).alias("level"),
        reason.alias("reason"),
        F.when(none, F.lit(0).cast("bigint")).otherwise(F.col("room_count")).alias("room_count"),
        F.when(none, F.lit(0.0)).otherwise(F.col("spread")).alias("spread"),
        F.when(~none, F.col("area_ratio")).alias("area_ratio"),
        (F.col("all") - F.when(none, F.lit(0)).otherwise(F.col("room_count"))).alias("rejected"),
    )


def representative(contributors: DataFrame, decisions: DataFrame) -> DataFrame:
    """(plan_id, room_id): the contributing room that stands for the scale: most axes, then nearest to it, then surest, then least id.

    contributors: plan_id, room_id, px, py, use_x, use_y, confidence. decisions: plan_id, ppf.
    """
    both = ~F.col("use_x") & ~F.col("use_y")
    x, y = F.col("use_x") | both, F.col("use_y") | both
    axes = x.cast("int") + y.cast("int")
    implied = (F.when(x, F.ln("px")).otherwise(F.lit(0.0)) + F.when(y, F.ln("py")).otherwise(F.lit(0.0))) / axes
    one = contributors.filter("px > 0 AND py > 0").join(decisions.filter("ppf > 0"), "plan_id").withColumns({"axes": axes, "far": F.round(F.abs(implied - F.ln("ppf")), 9)})
    return one.groupBy("plan_id").agg(F.min(F.struct((-F.col("axes")).alias("a"), "far", (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "room_id")).alias("b")).select("plan_id", "b.room_id")


def line_scale(lines: DataFrame) -> DataFrame:
    """(plan_id, x, y, axes, length_px, feet, line_count): feet per pixel by the lines drawn last.

    A diagonal sets both axes and takes the place of all lines before it; after it, the last line across and the last line down count. Two axes that agree are
    one scale, their geometric mean. lines: plan_id, ord, start, end, feet; lines without length or feet don't count.
    """
    px = F.hypot(F.col("end.x") - F.col("start.x"), F.col("end.y") - F.col("start.y"))
    good = lines.filter((F.col("feet") > 0) & (px > 0)).select("plan_id", "ord", "feet", px.alias("px"), F.abs(F.col("end.x") - F.col("start.x")).alias("dx"), F.abs(F.col("end.y") - F.col("start.y")).alias("dy"), geom.line_axis(F.col("start"), F.col("end")).alias("axis"))
    row = F.struct("ord", "feet", "px", "dx", "dy")
    last = lambda a: F.max(F.when(F.col("axis") == a, row))
    plan = good.groupBy("plan_id").agg(last("x").alias("ax"), last("y").alias("ay"), last("diagonal").alias("d"))
    # a diagonal counts only if nothing came after it; a line across or down only if no diagonal came after that
    after = lambda a, b: F.col(f"{a}.ord") > F.coalesce(F.col(f"{b}.ord"), F.lit(-(1 << 62)))
    plan = plan.withColumns({"ax": F.when(after("ax", "d"), F.col("ax")), "ay": F.when(after("ay", "d"), F.col("ay"))})
    plan = plan.withColumn("d", F.when(F.col("ax").isNull() & F.col("ay").isNull(), F.col("d")))
    two = F.col("ax").isNotNull() & F.col("ay").isNotNull()
    sx, sy = F.col("ax.feet") / F.col("ax.dx"), F.col("ay.feet") / F.col("ay.dy")
    ok = S.isotropy(sx, sy)["ok"]
    one = F.coalesce("d", "ax", "ay")
    x_weaker = F.col("ax.dx") <= F.col("ay.dy")
    single = one["feet"] / one["px"]
    return plan.select(
        "plan_id",
        F.when(two, F.when(ok, F.sqrt(sx * sy)).otherwise(sx)).otherwise(single).alias("x"),
        F.when(two, F.when(ok, F.sqrt(sx * sy)).otherwise(sy)).otherwise(single).alias("y"),
        F.when(two, F.lit("x,y")).when(F.col("d").isNotNull(), F.lit("diagonal")).when(F.col("ax").isNotNull(), F.lit("x")).otherwise(F.lit("y")).alias("axes"),
        F.when(two, F.when(x_weaker, F.col("ax.dx")).otherwise(F.col("ay.dy"))).otherwise(one["px"]).alias("length_px"),
        F.when(two, F.when(x_weaker, F.col("ax.feet")).otherwise(F.col("ay.feet"))).otherwise(one["feet"]).alias("feet"),
        F.when(two, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("line_count"),
    )
