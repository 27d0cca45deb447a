"""Levels, ranks and texts of warnings about a traced outline and its scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import units
from plumbline.functions.scale import percent_apart

# Warnings from the gravest to the least, which of them concern the whole result, and their short names.
CODES = (
    "no-boundary floor-empty unsealed self-intersecting covers-page floors-overlap inner-not-nested room-outside label-outside wall-left-outside annexation incomplete-enclosure "
    "brush-mismatch bridged-opening thin-structure-excluded tiny-floor inner-over-inset weak-wall-support heavy-closing drawn-freehand no-inner floors-rejected remediated no-alternative"
).split()
WHOLE = ("label-outside", "floors-rejected", "no-alternative", "no-boundary", "remediated")
LABELS = {
    "unsealed": "Outline never closed", "weak-wall-support": "Weak wall support", "bridged-opening": "Opening bridged", "heavy-closing": "Heavy closing",
    "annexation": "Reaches past its walls", "wall-left-outside": "Wall left outside", "thin-structure-excluded": "Thin structure excluded", "incomplete-enclosure": "Incomplete enclosure",
    "floors-rejected": "Outlines rejected", "no-boundary": "No outline traced", "floor-empty": "Floor has no polygon", "self-intersecting": "Outline crosses itself", "covers-page": "Covers the page",
    "tiny-floor": "Very small outline", "inner-not-nested": "Interior not nested", "inner-over-inset": "Interior inset far", "no-inner": "No interior envelope", "floors-overlap": "Floors overlap",
    "room-outside": "Room outside", "label-outside": "Label outside", "no-alternative": "Only one hypothesis", "brush-mismatch": "Does not match your outline", "drawn-freehand": "Freehand section",
    "remediated": "Traced again",
}


def level(confidence: Column) -> Column:
    """failed, good, fair or poor."""
    return F.when(confidence >= 0.75, F.lit("good")).when(confidence >= 0.5, F.lit("fair")).when(confidence > 0, F.lit("poor")).otherwise(F.lit("failed"))


def rank(severity: Column, code: Column) -> Column:
    """Errors before all else, then the order of CODES; an unknown code comes last."""
    at = F.array_position(F.array(*[F.lit(c) for c in CODES]), code)
    return (F.when(severity == "error", F.lit(0)).otherwise(F.lit(1000)) + F.when(at > 0, at - 1).otherwise(F.lit(999))).cast("bigint")


def short_name(code: Column) -> Column:
    """The short name of a warning; of an unknown one its code as a sentence."""
    plain = F.replace(F.coalesce(code, F.lit("")), F.lit("-"), F.lit(" "))
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2))))


def scope(code: Column, stated: Column) -> Column:
    return F.coalesce(stated, F.when(code.isin(*WHOLE), F.lit("result")).otherwise(F.lit("floor")))


def plural(n: Column, word: str = "room") -> Column:
    return F.concat(n.cast("bigint").cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def scale_short(source: Column, level_: Column, reason: Column, disagreement: Column, rooms: Column, adopted: Column) -> Column:
    """The short line on how far the scale can be trusted, or null where there is nothing to say. Texts are fixed values."""
    apart = percent_apart(F.coalesce(disagreement, F.lit(0.0))).cast("string")
    areas = percent_apart(2 * F.coalesce(disagreement, F.lit(0.0))).cast("string")
    n = plural(F.coalesce(rooms, F.lit(0)))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    auto = F.when(reason == "rooms-disagree", text("Rooms disagree by ~", apart, "%")).when(reason == "area-implausible", F.lit("Areas look too small for these rooms")).otherwise(text("Scale from ", n))
    line = (
        F.when(reason == "line-vs-rooms", text("Scale set by hand, areas ~", areas, "% different"))
        .when(reason == "scale-anisotropic", text("Across and down differ by ~", apart, "%"))
        .when(reason == "short-line", F.lit("Scale set by hand from a short line"))
        .otherwise(F.lit("Scale set by hand"))
    )
    room = F.when(reason == "room-vs-auto", text("Scale from this room, areas ~", areas, "% different")).when(
        reason == "room-vs-project", F.when(adopted, F.lit("This room disagrees with the last one")).otherwise(F.lit("Kept the scale from earlier rooms"))
    )
    by_room = F.coalesce(reason.isin("room-vs-auto", "room-vs-project", "room-internal"), F.lit(False))
    return F.when((source == "auto") & ~by_room, auto).when(source == "line", line).when((level_ != "ok") & reason.isNotNull(), room)


def _text(template: str, **values: Column) -> Column:
    """A template with {names} as an expression."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


# What is said of a warning beside its name.
BRIDGED = "a {px}px opening was bridged to close the outline"
ROOM_OUTSIDE = "the {name} room falls outside the traced outline"
LABELS_OUTSIDE = "{count} labelled area{s} fall outside the traced outline"
REJECTED = "{count} closed outline{were} judged not to be buildings"
TRACED_AGAIN = "the first outline left {before} of {of} known areas outside, so it was traced again — this one leaves {after}"


def detail(code: Column, message: Column, px: Column, name: Column, count: Column, of: Column, held_before: Column, held_after: Column) -> Column:
    """What a warning says at length: by its code, where its details are known, else its message."""
    s = F.when(count == 1, F.lit("")).otherwise(F.lit("s"))
    were = F.when(count == 1, F.lit(" was")).otherwise(F.lit("s were"))
    told = (
        F.when(code == "bridged-opening", _text(BRIDGED, px=px))
        .when((code == "room-outside") & (name != ""), _text(ROOM_OUTSIDE, name=name))
        .when(code == "label-outside", _text(LABELS_OUTSIDE, count=count, s=s))
        .when(code == "floors-rejected", _text(REJECTED, count=count, were=were))
        .when(code == "remediated", _text(TRACED_AGAIN, before=of - held_before, of=of, after=of - held_after))
    )
    return F.coalesce(told, message)


# What is said of a scale at length, by its source and reason.
SCALE_DETAILS = {
    ("auto", "too-few-rooms"): "Only {rooms} on this plan could be measured well enough to set the scale, so nothing outvoted them. Areas rest on that — check one room’s outline against its label, or click a dimension to set the scale from a room you trust.",
    ("auto", "rooms-disagree"): "The {rooms} used to set the scale imply sizes about {apart}% apart, which is more than printed dimensions normally vary. The middle of them is in use. Check the outlines, or click a dimension to set the scale from one room.",
    ("auto", "area-implausible"): "At this scale the traced building comes out smaller than the rooms its own labels describe, so the scale is probably too high and every area too small. Click a dimension on a plainly rectangular room to set the scale from it instead.",
    ("auto", ""): "The scale was measured from {rooms} on this plan rather than one, and is the middle of what they imply — individually they span about {apart}%, which is normal for printed dimensions. Click a dimension to set the scale from a single room instead.",
    ("line", "line-vs-rooms"): "The line you drew implies a scale about {apart}% from the rooms the app measured itself, which moves every area by roughly {areas}%. Your line is in use. Clear it to go back to the measured average.",
    ("line", "scale-anisotropic"): "Your two lines say the drawing is about {apart}% more stretched across than down. Both are in use, so areas are unaffected — only side lengths follow the direction they run.",
    ("line", "short-line"): "The line is only {length} px long, so a pixel of click error is about {apart}%. Draw it along the longest wall you can identify, or zoom in first.",
    ("line", "two"): "The scale comes from two lines you drew, one across and one down.",
    ("line", ""): "The scale comes from a {feet} ft line you drew, applied to both directions.",
    ("room", "room-vs-auto"): "This room implies a scale about {apart}% from the {rooms} the app measured itself, which moves every area by roughly {areas}%. Your choice is in use. Re-scan to go back to the measured average.",
    ("room", "adopted"): "This room is about {apart}% out from the {rooms} measured before it, and the newer measurement is the one now in use. One of the two outlines or labels is wrong — measure a third room to settle it.",
    ("room", "held"): "This room implies a scale about {apart}% different from the {rooms} measured before it, so it was not used — areas are unchanged. Check this room’s outline and label.",
    ("room", "check"): "This room’s outline and its label disagree by about {apart}% about how big the room is. The scale was set from the average of the two, so areas could be off by roughly that much. Check the outline against the label.",
    ("room", ""): "This room’s outline and label are about {apart}% apart, which is normal for printed dimensions. The scale is the average of the two.",
}


def scale_detail(source: Column, level_: Column, reason: Column, disagreement: Column, rooms: Column, adopted: Column, length_px: Column, feet: Column, lines: Column) -> Column:
    """struct<level, detail>: what is said at length of how far the scale can be trusted; null where there is nothing to say."""
    values = {
        "apart": percent_apart(F.coalesce(disagreement, F.lit(0.0))), "areas": percent_apart(2 * F.coalesce(disagreement, F.lit(0.0))), "rooms": plural(F.coalesce(rooms, F.lit(0))), "length": length_px,
        "feet": F.regexp_replace(F.regexp_replace(units.fixed(F.coalesce(feet, F.lit(0.0)), 2), r"(\.\d*?)0+$", "$1"), r"\.$", ""),
    }
    by_room = F.coalesce(reason.isin("room-vs-auto", "room-vs-project", "room-internal"), F.lit(False))
    auto = F.when(reason.isin("too-few-rooms", "rooms-disagree", "area-implausible"), reason).otherwise(F.lit(""))
    line = F.when(reason.isin("line-vs-rooms", "scale-anisotropic", "short-line"), reason).when(lines == 2, F.lit("two")).otherwise(F.lit(""))
    check = level_ == "check"
    room = F.when(reason == "room-vs-auto", reason).when(reason == "room-vs-project", F.when(adopted, F.lit("adopted")).otherwise(F.lit("held"))).when(check, F.lit("check")).otherwise(F.lit(""))
    kind = F.when((source == "auto") & ~by_room, F.lit("auto")).when(source == "line", F.lit("line")).when((level_ != "ok") & reason.isNotNull(), F.lit("room"))
    sub = F.when(kind == "auto", auto).when(kind == "line", line).otherwise(room)
    texts = F.create_map(*[F.lit(x) for (k, r), template in SCALE_DETAILS.items() for x in (f"{k}/{r}", template)])
    told = F.try_element_at(texts, F.concat_ws("/", kind, sub))
    for name, value in values.items():
        told = F.replace(told, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    grave = (
        F.when(kind == "auto", F.when(auto == "", F.lit("note")).otherwise(F.lit("check")))
        .when(kind == "line", F.when((line == "line-vs-rooms") & check, F.lit("check")).otherwise(F.lit("note")))
        .otherwise(F.when(sub.isin("adopted", "held"), F.lit("check")).when(check, F.lit("check")).otherwise(F.lit("note")))
    )
    return F.when(kind.isNotNull(), F.struct(grave.alias("level"), told.alias("detail")))
