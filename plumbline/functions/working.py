"""The working state of a drawing as columns: defaults, snapshots, calibrations, voids, names. Every rule is a Column expression or a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geom, labels

# Fields of a state that has not been touched, as SQL literals.
DEFAULTS = {
    "image": "CAST(NULL AS STRING)", "unit": "'decimal'", "mode": "'normal'", "show_side_lengths": "true", "use_interior_walls": "false", "auto_snap": "true", "eraser_size": "60",
    "brush_size": "48", "stage_x": "0.0D", "stage_y": "0.0D", "rotation": "0.0D", "project_name": "''",
    "calibration": "named_struct('calibrated', false, 'x', 1.0D, 'y', 1.0D, 'source', CAST(NULL AS STRING), 'room', CAST(NULL AS BIGINT))",
}
CALIBRATION_SOURCES = ("room-calibration", "line-calibration")
EXPORT_OPTIONS = {"sideLengths": True, "outlineLabels": True, "annotations": True, "summary": True}
LEAST_GAP = 1e-10  # squared


def default(field: str) -> Column:
    return F.expr(DEFAULTS[field])


def applied(snapshot: DataFrame) -> DataFrame:
    """A snapshot put to use: fields that are null or not there have their defaults."""
    return snapshot.withColumns({f: F.coalesce(F.col(f), default(f)) if f in snapshot.columns else default(f) for f in DEFAULTS})


def adopted(parked: DataFrame, present: str = "present") -> DataFrame:
    """A state that was set aside: fields that its array of names lists as they are, null or not, and the others their defaults."""
    has = lambda f: F.array_contains(F.coalesce(present, F.array().cast("array<string>")), f)
    return parked.withColumns({f: F.when(has(f), F.col(f)).otherwise(default(f)) for f in DEFAULTS if f in parked.columns})


def restored(live: Column, saved: Column, present: Column, field: str) -> Column:
    """A field after a saved state was read over a live one: only the fields that it has count."""
    return F.when(F.array_contains(present, field), saved).otherwise(live)


def for_saving(live: Column, record: Column, field: str) -> Column:
    """A field of the state that is written for a drawing which is not the live one: the record's, else the live one's; but an image never comes from the live one."""
    return record if field == "image" else F.coalesce(record, live)


def selected(active: Column, ids: Column) -> Column:
    """The active outline, or the first where that is gone; null for none."""
    return F.when(F.array_contains(ids, active), active).otherwise(F.get(ids, F.lit(0)))


def calibrated(x: Column, y: Column, room: Column, source: Column) -> Column:
    """struct<calibration, error>: a scale of feet per pixel, if a source may set it and it is a positive finite number on both axes."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    error = F.when(~F.coalesce(source.isin(*CALIBRATION_SOURCES), F.lit(False)), F.lit("source")).when(~(F.coalesce(good(x) & good(y), F.lit(False))), F.lit("scale"))
    told = F.struct(F.lit(True).alias("calibrated"), x.alias("x"), y.alias("y"), source.alias("source"), room.cast("bigint").alias("room"))
    return F.struct(F.when(error.isNull(), told).alias("calibration"), error.alias("error"))


def without_lines(calibration: Column) -> Column:
    """The calibration after all drawn lines were cleared: gone if they had set it."""
    return F.when(calibration["source"].eqNullSafe(F.lit("line-calibration")), default("calibration")).otherwise(calibration)


def after_line_removed(calibration: Column, resolved: Column) -> Column:
    """The calibration after one line was removed: the scale that the other lines give (struct<x, y>), or none if none give one and lines had set it."""
    by_lines = F.struct(F.lit(True).alias("calibrated"), resolved["x"].alias("x"), resolved["y"].alias("y"), F.lit("line-calibration").alias("source"), F.lit(None).cast("bigint").alias("room"))
    return F.when(resolved.isNotNull(), by_lines).otherwise(without_lines(calibration))


_HOLE = "struct<id:string,ring:array<struct<x:double,y:double>>,source:string,stale:boolean>"


def hole_keys(holes: Column) -> Column:
    """The key of each void: its id, or its place."""
    return F.transform(holes, lambda h, i: F.coalesce(h["id"], F.concat(F.lit("ring-"), i.cast("string"))))


def with_hole(holes: Column, id_: Column, ring: Column) -> Column:
    """Voids with one more, of the user's; a ring of fewer than three corners adds none."""
    one = F.struct(id_.alias("id"), ring.alias("ring"), F.lit("user").alias("source"), F.lit(False).alias("stale")).cast(_HOLE)
    held = F.coalesce(holes, F.array().cast(f"array<{_HOLE}>"))
    return F.when(F.size(ring) >= 3, F.concat(held, F.array(one))).otherwise(held)


def without_hole(holes: Column, key: Column) -> Column:
    """Voids without the one of a key."""
    held = F.zip_with(holes, hole_keys(holes), lambda h, k: F.struct(h.alias("h"), k.alias("k")))
    return F.transform(F.filter(held, lambda p: p["k"] != key), lambda p: p["h"])


def with_line(lines: Column, line: Column) -> Column:
    """Drawn lines with one more, if it has both ends."""
    return F.when(line["start"].isNotNull() & line["end"].isNotNull(), F.concat(lines, F.array(line))).otherwise(lines)


def vertex_may_move(ring: Column, i: Column, to: Column) -> Column:
    """Whether a closed ring stays simple where its vertex i moves to a point: only the two edges that change are tried, against all others."""
    n = F.size(ring)
    before, after = F.pmod(i - 1, n), F.pmod(i + 1, n)

    def judged(s: Column) -> Column:
        to, p, q = s["to"], s["p"], s["q"]

        def clash(e: Column) -> Column:
            a, b = e["a"], e["b"]
            k = F.pmod(e["i"] + 1, s["n"])
            near = (a["x"] - to["x"]) * (a["x"] - to["x"]) + (a["y"] - to["y"]) * (a["y"] - to["y"]) < LEAST_GAP
            by_p = F.when(e["i"] == s["before"], geom.folds_back(b, p, to)).when(k == s["before"], geom.folds_back(a, p, to)).otherwise(geom.segments_cross(p, to, a, b))
            by_q = F.when(e["i"] == s["after"], geom.folds_back(to, q, b)).when(k == s["after"], geom.folds_back(to, q, a)).otherwise(geom.segments_cross(to, q, a, b))
            return F.when(e["i"] == s["i"], F.lit(False)).when(k == s["i"], near).otherwise(near | by_p | by_q)

        return ~geom.folds_back(p, to, q) & ~F.exists(s["e"], clash)

    bound = F.struct(geom.edges(ring).alias("e"), to.alias("to"), F.get(ring, before).alias("p"), F.get(ring, after).alias("q"), n.alias("n"), i.alias("i"), before.alias("before"), after.alias("after"))
    return F.when(F.coalesce(n, F.lit(0)) < 3, F.lit(True)).otherwise(geom.let(bound, judged))


def document_label(name: Column, file: Column, index: Column) -> Column:
    """What a drawing is called: its name, else its file's without the ending, else its place among the untitled."""
    n, f = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(file, F.lit("")))
    stem = F.regexp_replace(f, r"\.[^./\\]+$", "")
    return F.when(n != "", n).when(f != "", F.when(stem != "", stem).otherwise(f)).otherwise(F.concat(F.lit("Untitled "), (index + 1).cast("string")))


def export_options(stored: Column) -> Column:
    """struct of EXPORT_OPTIONS: each as a map of stored ones has it, if that is a yes or no, else as it is by default."""
    told = lambda k: F.when(F.try_element_at(stored, F.lit(k)) == "true", True).when(F.try_element_at(stored, F.lit(k)) == "false", False)
    return F.struct(*[F.coalesce(told(k), F.lit(v)).alias(k) for k, v in EXPORT_OPTIONS.items()])


def wrapped(text: Column, most: Column) -> Column:
    """array<string>: words of a text filled into lines of at most so many characters; a longer word has a line of its own."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(w) <= most
        return F.when(F.size(lines) == 0, F.array(w)).when(fits, F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def other_samples(rooms: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Scales of the rooms (array<struct<left, top, right, bottom, sx, sy>>) but of the one whose middle is under a box; corners in any order. A room without a box counts, one without a scale doesn't."""
    cx, cy = lambda r: (r["left"] + r["right"]) / 2, lambda r: (r["top"] + r["bottom"]) / 2
    under = lambda r: F.coalesce(cx(r).between(F.least(x0, x1), F.greatest(x0, x1)) & cy(r).between(F.least(y0, y1), F.greatest(y0, y1)), F.lit(False))
    return F.flatten(F.transform(F.filter(rooms, lambda r: ~under(r) & r["sx"].isNotNull()), lambda r: F.array(r["sx"], r["sy"])))


def unique_names(df: DataFrame, by: list[str], name: str, order: str, default_name: str = "Sketch") -> DataFrame:
    """df with unique_name: the name, trimmed, or one by default; the second of a name within by has " (2)" after it, and so on. A name that someone has given already is passed over.

    The k-th of a name takes the k-th number that is free: numbers taken by names as given are counted out, so no names are tried one by one.
    """
    base = F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.lit(default_name)).otherwise(F.trim(name))
    one = df.withColumn("_base", base).withColumn("_k", F.row_number().over(W.partitionBy(*by, "_base").orderBy(order)))
    number = F.regexp_extract("_base", r"^(.*) \((\d{1,9})\)$", 2)
    given = one.filter("_k = 1").select(*by, F.regexp_extract("_base", r"^(.*) \((\d{1,9})\)$", 1).alias("_base"), F.when(number != "", number.cast("int")).alias("_taken")).filter("_taken >= 2")
    taken = given.groupBy(*by, "_base").agg(F.sort_array(F.collect_set("_taken")).alias("_t"))
    # the k-th free number from 2 on: each taken one up to it moves it on
    free = F.aggregate(F.coalesce("_t", F.array().cast("array<int>")), F.col("_k"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    named = one.join(taken, [*by, "_base"], "left")
    return named.withColumn("unique_name", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" ("), free.cast("string"), F.lit(")")))).drop("_base", "_k", "_t")


def without_outline(outlines: DataFrame, gone: DataFrame) -> DataFrame:
    """(plan_id, ord, trace_id, active): the outlines left after one of each plan was deleted; where it was the active one, its left neighbour is, or the first. outlines: plan_id, ord, trace_id, active. gone: plan_id, trace_id."""
    order = W.partitionBy("plan_id").orderBy("ord")
    one = outlines.join(gone.select("plan_id", F.col("trace_id").alias("_gone")), "plan_id", "left").withColumn("_is", F.coalesce(F.col("trace_id") == F.col("_gone"), F.lit(False)))
    one = one.withColumn("_was", F.max(F.col("_is") & F.col("active")).over(W.partitionBy("plan_id")))
    one = one.withColumn("_next", F.coalesce(F.lead("_is").over(order), F.lit(False)) | (F.coalesce(F.lag("_is").over(order), F.lit(False)) & (F.row_number().over(order) == 2)))
    left = one.filter(~F.col("_is"))
    return left.select("plan_id", "ord", "trace_id", F.when(F.col("_was"), F.col("_next")).otherwise(F.col("active")).alias("active"))


def migrated_type(type_: Column) -> Column:
    return labels.normal_type(type_)
