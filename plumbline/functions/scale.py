"""The drawing's scale from measured rooms and drawn lines. Scales are pixels per foot in samples, feet per pixel in decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.geom import let

# Tolerances as log distances, and limits of the consensus.
ISOTROPY, KEEP, PLAN_SPREAD, ROOM_GAP = 0.05, 0.25, 0.22, 0.03
CONFIDENCE_FLOOR, MIN_ROOMS, SPREAD_LIMIT, FOOTPRINT_TO_LABELS = 0.5, 3, 0.45, 0.7
MIN_LINE_PX, CLICK_PX = 100.0, 2.0


def upper_median(sorted_values: Column) -> Column:
    """The middle of a sorted array; of two middles the upper. Null for none."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def log_gap(a: Column, b: Column) -> Column:
    return F.abs(F.ln(a / b))


def robust(samples: Column) -> Column:
    """struct<value, median, spread, samples, kept>: the median of the positive finite samples within KEEP of their median; null for none."""
    good = F.array_sort(F.filter(samples, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))))

    def told(g: Column, median: Column) -> Column:
        return let(
            F.filter(g, lambda v: log_gap(v, median) <= KEEP),
            lambda kept: F.struct(F.coalesce(upper_median(kept), median).alias("value"), median.alias("median"), (F.get(g, F.size(g) - 1) / F.get(g, F.lit(0))).alias("spread"), F.size(g).alias("samples"), F.size(kept).alias("kept")),
        )

    return let(good, lambda g: F.when(F.size(g) > 0, let(upper_median(g), lambda m: told(g, m))))


def oriented(dw: Column, dh: Column, bw: Column, bh: Column) -> Column:
    """struct<width, height, swapped>: a label's two lengths in the order that suits the box, as written unless the other is nearer."""
    good = (dw > 0) & (dh > 0) & (bw > 0) & (bh > 0)
    label, box = F.ln(dw / dh), F.ln(bw / bh)
    swap = good & (F.abs(label - box) > ISOTROPY) & (F.abs(label + box) < F.abs(label - box))
    swap = F.coalesce(swap, F.lit(False))
    return F.struct(F.when(swap, dh).otherwise(dw).alias("width"), F.when(swap, dw).otherwise(dh).alias("height"), swap.alias("swapped"))


def isotropy(x: Column, y: Column, tolerance: float = ISOTROPY) -> Column:
    """struct<ok, ratio, log_distance> of the scales of the axes; no ratio unless both are positive."""
    good = (x > 0) & (y > 0)
    return F.struct(F.coalesce(good & (log_gap(x, y) <= tolerance), F.lit(False)).alias("ok"), F.when(good, x / y).alias("ratio"), F.when(good, log_gap(x, y)).alias("log_distance"))


def _room(dw: Column, dh: Column, bw: Column, bh: Column, n: Column, plan: Column) -> Column:
    def told(x: Column, y: Column) -> Column:
        iso = isotropy(x, y)
        one = F.when((n >= 4) & (plan["spread"] <= 2), plan["value"]).otherwise(F.sqrt(x * y))
        return F.struct(F.when(iso["ok"], x).otherwise(one).alias("x"), F.when(iso["ok"], y).otherwise(one).alias("y"), iso["ok"].alias("ok"), iso["log_distance"].alias("log_distance"))

    d = oriented(dw, dh, bw, bh)
    return let(F.struct((d["width"] / bw).alias("x"), (d["height"] / bh).alias("y")), lambda s: told(s["x"], s["y"]))


def room_scale(dw: Column, dh: Column, bw: Column, bh: Column, samples: Column) -> Column:
    """struct<x, y, ok, log_distance>, feet per pixel: that of each axis if they agree, else the plan's robust scale if it has four samples
    within a factor of two, else the geometric mean."""
    return let(robust(samples), lambda plan: _room(dw, dh, bw, bh, F.size(samples), plan))


def decide(dw: Column, dh: Column, bw: Column, bh: Column, others: Column) -> Column:
    """struct<x, y, adopted, level, reason, disagreement, room_scale, project_scale, room_count>: whether one room sets the plan's scale.

    A room more than PLAN_SPREAD from the others is flagged; with four samples within a factor of two the others stay in force.
    """
    return let(robust(others), lambda plan: decide_by(dw, dh, bw, bh, F.size(others), plan))


def decide_by(dw: Column, dh: Column, bw: Column, bh: Column, n: Column, plan: Column) -> Column:
    """decide(), where robust() of the n other samples is a column already."""

    def told(room: Column) -> Column:
        known = (n >= 2) & plan.isNotNull()
        gap = F.when(known, log_gap(room["x"], plan["value"])).otherwise(F.lit(0.0))
        apart = known & (gap > PLAN_SPREAD)
        held = apart & (n >= 4) & (plan["spread"] <= 2)
        inner = F.when(room["ok"], F.lit("ok")).when(room["log_distance"] > 0.25, F.lit("check")).otherwise(F.lit("note"))
        return F.struct(
            F.when(held, plan["value"]).otherwise(room["x"]).alias("x"),
            F.when(held, plan["value"]).otherwise(room["y"]).alias("y"),
            (~held).alias("adopted"),
            F.when(apart, F.lit("check")).otherwise(inner).alias("level"),
            F.when(apart, F.lit("room-vs-project")).when(~room["ok"], F.lit("room-internal")).alias("reason"),
            F.when(apart, gap).when(room["ok"], F.lit(0.0)).otherwise(room["log_distance"]).alias("disagreement"),
            room["x"].alias("room_scale"),
            F.when(known, plan["value"]).alias("project_scale"),
            F.floor(n / 2).cast("bigint").alias("room_count"),
        )

    return let(_room(dw, dh, bw, bh, n, plan), told)


def percent_apart(log_distance: Column) -> Column:
    return F.floor((F.exp(log_distance) - 1) * 100 + 0.5)


def user_asserted(source: Column) -> Column:
    return F.coalesce(source.isin("manual", "line"), F.lit(False))


def constraint_factor(missed: Column, total: Column, drawn: Column) -> Column:
    """What missed constraints leave of a confidence; drawn outlines are judged more softly."""
    share = missed / total
    return F.when((F.coalesce(total, F.lit(0)) == 0) | (F.coalesce(missed, F.lit(0)) == 0), F.lit(1.0)).when(drawn, F.greatest(F.lit(0.85), 1 - 0.3 * share)).otherwise(F.greatest(F.lit(0.35), 1 - share))
