"""What a report says of a drawing, as Column expressions: edges with lengths, notes on voids, the scale in words, layouts of angles and of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import geom, labels, units


def edge_labels(ring: Column, fx: Column, fy: Column, unit: Column, style: Column) -> Column:
    """array<struct<text, x, y, nx, ny, px>>: length, middle and normal, on the side that the winding gives, of each edge that has a length."""
    side = F.when(geom.over_edges(ring, lambda a, b: (b["x"] - a["x"]) * (b["y"] + a["y"])) > 0, 1.0).otherwise(-1.0)

    def one(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        px = F.hypot(dx, dy)
        return F.struct(
            units.format_length(F.hypot(dx * fx, dy * fy), unit, style).alias("text"), ((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y"), (dy / px * side).alias("nx"), (-dx / px * side).alias("ny"), px.alias("px")
        )

    return F.transform(F.filter(geom.edges(ring), lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"])), one)


def void_note(holes: Column, fx: Column, fy: Column, unit: Column) -> Column:
    """How many voids are deducted, with their area, and how many are not; null for none."""
    good = F.filter(holes, lambda h: F.size(h["ring"]) >= 3)
    live = F.filter(good, lambda h: ~F.coalesce(h["stale"], F.lit(False)))
    n, stale = F.size(live), F.size(good) - F.size(live)
    area = units.format_area(F.aggregate(live, F.lit(0.0), lambda a, h: a + geom.ring_area(h["ring"])) * fx * fy, unit)
    cut = F.when(n > 0, F.concat(F.lit("−"), n.cast("string"), F.when(n == 1, F.lit(" void (")).otherwise(F.lit(" voids (")), area["value"], F.lit(" "), area["suffix"], F.lit(")")))
    rest = F.when(stale > 0, F.concat(stale.cast("string"), F.lit(" outside the outline, not deducted")))
    return F.nullif(F.concat_ws(" · ", cut, rest), F.lit(""))


def scale_text(calibrated: Column, fx: Column, fy: Column) -> Column:
    """The scale in pixels per foot; both axes if they differ."""
    px, py = 1 / fx, 1 / fy
    both = F.concat(units.fixed(px, 2), F.lit(" × "), units.fixed(py, 2), F.lit(" px/ft"))
    return F.when(~calibrated | ~(fx > 0) | ~(fy > 0), F.lit("Not set")).when(F.abs(px - py) > 1e-6, both).otherwise(F.concat(F.lit("1 ft = "), units.fixed(px, 1), F.lit(" px")))


def scale_origin(calibrated: Column, source: Column, rooms: Column) -> Column:
    """Where the scale comes from. Texts are fixed values."""
    n = F.concat(F.lit("Measured from "), rooms.cast("string"), F.when(rooms == 1, F.lit(" room")).otherwise(F.lit(" rooms")), F.lit(" on this plan."))
    return (
        F.when(~calibrated, F.lit("No scale was set — areas are not to scale."))
        .when(source == "line-calibration", F.lit("Set by hand from a line of known length."))
        .when(rooms > 0, n)
        .otherwise(F.lit("Measured from the room size entered by hand."))
    )


def outline_row(name: Column, type_: Column, area: Column, unit: Column, calibrated: Column) -> Column:
    """struct<type_label, area_text>: the type unless the name says it, and the area unless there is no scale."""
    a, label = units.format_area(area, unit), labels.type_label(type_)
    return F.struct(F.nullif(label, name).alias("type_label"), F.when(calibrated, F.concat(a["value"], F.lit(" "), a["suffix"])).otherwise(F.lit("—")).alias("area_text"))


def polar(cx: Column, cy: Column, angle: Column, radius: Column) -> Column:
    return F.struct((cx + F.cos(angle) * radius).alias("x"), (cy + F.sin(angle) * radius).alias("y"))


def angle_layout(cx: Column, cy: Column, first: Column, second: Column, arc: Column, zoom: Column) -> Column:
    """struct<start, sweep, degrees, bisector, label_x, label_y, hidden, straight>: the smaller angle between two directions, its label 20 screen pixels beyond the arc."""
    turn = 2 * F.pi()
    diff = second - first - turn * F.ceil((second - first - F.pi()) / turn)  # in (-pi, pi]
    sweep, start = F.abs(diff), F.when(diff >= 0, first).otherwise(second)
    bisector, reach = start + sweep / 2, arc / zoom + 20 / zoom
    label = polar(cx, cy, bisector, reach)
    return F.struct(
        start.alias("start"), sweep.alias("sweep"), F.degrees(sweep).alias("degrees"), bisector.alias("bisector"), label["x"].alias("label_x"), label["y"].alias("label_y"), (sweep * arc < 3).alias("hidden"), (F.abs(sweep - F.pi()) < 0.005).alias("straight")
    )


def plan_frame(width: Column, height: Column, degrees: Column, most: float) -> Column:
    """struct<width, height, scale>: the box of a turned page, shrunk to a width but never enlarged."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    w, h = width * c + height * s, width * s + height * c
    scale = F.least(F.lit(1.0), F.lit(most) / w)
    return F.struct((w * scale).alias("width"), (h * scale).alias("height"), scale.alias("scale"))


def on_page(x: Column, y: Column, width: Column, height: Column, degrees: Column, frame: Column) -> Column:
    """A point of the drawing on the turned and shrunk page."""
    dx, dy, c, s = x - width / 2, y - height / 2, F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    k = frame["scale"]
    return F.struct((frame["width"] / 2 + k * (dx * c - dy * s)).alias("x"), (frame["height"] / 2 + k * (dx * s + dy * c)).alias("y"))


# Warnings that point at nothing, and those that point at their whole outline.
NOWHERE = ("no-boundary", "floor-empty", "bridged-opening", "brush-mismatch", "thin-structure-excluded", "drawn-freehand", "floors-rejected", "no-alternative")
WHOLE_OUTLINE = (
    "unsealed", "self-intersecting", "covers-page", "tiny-floor", "no-inner", "inner-not-nested", "inner-over-inset", "incomplete-enclosure", "wall-left-outside", "annexation", "heavy-closing", "weak-wall-support", "remediated",
)
