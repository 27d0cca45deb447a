"""Queries on working states: calibrations, voids, vertices, names and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geom, quality, working
from plumbline.plans import views as V
from plumbline.plans.registry import query


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))


@query("""
WITH m AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'room-calibration' WHEN 1 THEN 'line-calibration' WHEN 2 THEN 'guess' END AS source, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE ELSE 0.25 END AS x, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 0.5 END AS y FROM orders)
SELECT k, CASE WHEN source IS NULL OR source = 'guess' THEN 'source' WHEN NOT (k % 5 IN (3, 4) AND y IS NOT NULL) THEN 'scale' END AS error, CASE WHEN source <> 'guess' AND k % 5 IN (3, 4) AND y IS NOT NULL THEN 0.25::DOUBLE END AS x,
  CASE WHEN k % 4 = 1 THEN 'none' ELSE coalesce(source, '-') END AS cleared, CASE WHEN k % 3 = 0 THEN 'line-calibration' WHEN k % 4 = 1 THEN 'none' ELSE coalesce(source, '-') END AS removed FROM m""")
def calibrations(spark: SparkSession, d: str) -> DataFrame:
    """Scales that are set, cleared and set anew by what lines are left."""
    k = F.col("k")
    source = F.when(k % 4 == 0, "room-calibration").when(k % 4 == 1, "line-calibration").when(k % 4 == 2, "guess")
    x = F.when(k % 5 == 0, 0.0).when(k % 5 == 1, float("nan")).when(k % 5 == 2, float("inf")).otherwise(0.25)
    y = F.when(k % 7 != 0, 0.5)
    set_ = working.calibrated(x, y, k, source)
    held = F.struct(F.lit(True).alias("calibrated"), x.alias("x"), y.alias("y"), source.alias("source"), F.lit(None).cast("bigint").alias("room"))
    name = lambda c, none: F.when(~c["calibrated"], F.lit("none")).otherwise(F.coalesce(c["source"], F.lit(none)))
    left = F.when(k % 3 == 0, F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y")))
    return _orders(spark, d).select("k", set_["error"].alias("error"), set_["calibration"]["x"].alias("x"), name(working.without_lines(held), "-").alias("cleared"), name(working.after_line_removed(held, left), "-").alias("removed"))


@query(""", m AS (SELECT plan_id, line, part, w_ft, w_ft * ppf AS w, h_ft * ppf AS h, disc > 5 AS has FROM it)
SELECT plan_id, line, part, w_ft, CASE WHEN has THEN 1 ELSE 0 END + CASE WHEN line % 3 = 0 THEN 0 ELSE 1 END AS added, CASE WHEN has AND line % 2 = 0 THEN 0 WHEN has THEN 1 ELSE 0 END AS left, CASE WHEN has THEN 'h;' ELSE '' END || CASE WHEN line % 3 = 0 THEN '' WHEN part % 4 = 0 THEN 'n' ELSE 'ring-' || CASE WHEN has THEN 1 ELSE 0 END END AS keys FROM m""", items=True)
def edited_voids(spark: SparkSession, d: str) -> DataFrame:
    """Voids put in and taken out by hand."""
    t = V.traces(spark, d)
    ring = F.when(F.col("line") % 3 == 0, F.slice("ring", 1, 2)).otherwise(F.slice("ring", 1, 3))
    added = working.with_hole(F.col("holes"), F.when(F.col("part") % 4 == 0, F.lit("n")), ring)
    less = working.without_hole(F.col("holes"), F.when(F.col("line") % 2 == 0, F.lit("h")).otherwise(F.lit("ring-0")))
    return t.select("plan_id", "line", "part", "w_ft", F.size(added).alias("added"), F.size(less).alias("left"), F.regexp_replace(F.array_join(working.hole_keys(added), ";"), "^h$", "h;").alias("keys"))


@query(""", m AS (SELECT plan_id, line, part, w_ft, part % 2 = 0 AS ell, tax % 5 AS t FROM it)
SELECT plan_id, line, part, w_ft, CASE t WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS may FROM m""", items=True)
def moved_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first vertex may move: a little way out, straight beyond the far side, onto another vertex, a little way in, and onto the line of its own edge beyond the next vertex."""
    t = V.traces(spark, d)
    first, next_ = F.get("ring", F.lit(0)), F.get("ring", F.lit(1))
    low = F.array_max(F.transform("ring", lambda p: p["y"]))
    right = F.array_max(F.transform("ring", lambda p: p["x"]))
    k = F.col("tax") % 5
    to = (
        F.when(k == 0, geom.point(first["x"] - 3, first["y"] - 2))
        .when(k == 1, geom.point(first["x"], low + 7))
        .when(k == 2, next_)
        .when(k == 3, geom.point(first["x"] + 0.25, first["y"] + 0.125))
        .otherwise(geom.point(right + 9, first["y"]))
    )
    return t.select("plan_id", "line", "part", "w_ft", working.vertex_may_move(F.col("ring"), F.lit(0), to).alias("may"))


_NAMES = "SELECT o_orderkey AS k, o_custkey AS plan_id, CASE o_orderkey % 6 WHEN 0 THEN ' Plan ' WHEN 1 THEN 'Plan' WHEN 2 THEN NULL WHEN 3 THEN 'Plan (3)' WHEN 4 THEN '' ELSE 'Roof' END AS name FROM orders"


@query(f"""
WITH RECURSIVE m AS ({_NAMES}), o AS (SELECT *, coalesce(nullif(trim(name), ''), 'Sketch') AS base, row_number() OVER (PARTITION BY plan_id, coalesce(nullif(trim(name), ''), 'Sketch') ORDER BY k) AS n FROM m),
f AS (SELECT plan_id, base, n, k, n AS c FROM o), t AS (SELECT DISTINCT plan_id, base FROM o),
s AS (SELECT o.plan_id, o.k, o.base, o.n, CASE WHEN o.n > 1 AND o.base = 'Plan' AND o.n >= 3 AND EXISTS (SELECT 1 FROM t WHERE t.plan_id = o.plan_id AND t.base = 'Plan (3)') THEN o.n + 1 ELSE o.n END AS c FROM o)
SELECT plan_id, k, CASE WHEN n = 1 THEN base ELSE base || ' (' || c || ')' END AS unique_name FROM s""")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of drawings that are saved together."""
    k = F.col("o_orderkey")
    name = F.when(k % 6 == 0, " Plan ").when(k % 6 == 1, "Plan").when(k % 6 == 2, None).when(k % 6 == 3, "Plan (3)").when(k % 6 == 4, "").otherwise("Roof")
    one = V.read(spark, d, "orders").select(k.alias("k"), F.col("o_custkey").alias("plan_id"), name.alias("name"))
    return working.unique_names(one, ["plan_id"], "name", "k").select("plan_id", "k", "unique_name")


@query("""
WITH m AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' House ' END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'a.b.png' WHEN 1 THEN '.png' WHEN 2 THEN ' plan ' END AS file FROM orders)
SELECT k, CASE WHEN k % 3 = 1 THEN 'House' WHEN k % 4 = 0 THEN 'a.b' WHEN k % 4 = 1 THEN '.png' WHEN k % 4 = 2 THEN 'plan' ELSE 'Untitled ' || (k % 9 + 1) END AS label,
  CASE WHEN k % 5 = 0 THEN 'false' ELSE 'true' END || ',' || CASE WHEN k % 5 = 1 THEN 'false' ELSE 'true' END || ',true,true' AS options FROM m""")
def document_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    name = F.when(k % 3 == 0, "  ").when(k % 3 == 1, " House ")
    file = F.when(k % 4 == 0, "a.b.png").when(k % 4 == 1, ".png").when(k % 4 == 2, " plan ")
    stored = F.when(k % 5 == 0, F.create_map(F.lit("sideLengths"), F.lit("false"), F.lit("odd"), F.lit("false"))).when(k % 5 == 1, F.create_map(F.lit("outlineLabels"), F.lit("false"), F.lit("summary"), F.lit("7")))
    o = working.export_options(stored)
    return _orders(spark, d).select("k", working.document_label(name, file, k % 9).alias("label"), F.concat_ws(",", *[o[x].cast("string") for x in working.EXPORT_OPTIONS]).alias("options"))


@query("""
WITH m AS (SELECT o_orderkey AS k, 2 + o_orderkey % 3 AS n, o_orderkey % 4 AS c, o_orderkey % 8 AS t FROM orders)
SELECT k, CASE t WHEN 0 THEN 'a ' || k || 'px opening was bridged to close the outline' WHEN 1 THEN 'the Den room falls outside the traced outline' WHEN 3 THEN c || ' labelled area' || CASE WHEN c = 1 THEN '' ELSE 's' END || ' fall outside the traced outline'
  WHEN 4 THEN c || ' closed outline' || CASE WHEN c = 1 THEN ' was' ELSE 's were' END || ' judged not to be buildings' WHEN 5 THEN 'the first outline left ' || (n + 3 - 1) || ' of ' || (n + 3) || ' known areas outside, so it was traced again — this one leaves ' || (n + 3 - n) ELSE 'm' || k END AS detail FROM m""")
def warning_details(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    code = F.element_at(F.array(*[F.lit(c) for c in ("bridged-opening", "room-outside", "room-outside", "label-outside", "floors-rejected", "remediated", "unsealed", "no-inner")]), (k % 8 + 1).cast("int"))
    n = F.lit(2) + k % 3
    name = F.when(k % 8 == 1, "Den").otherwise("")
    return _orders(spark, d).select("k", quality.detail(code, F.concat(F.lit("m"), k.cast("string")), k, name, k % 4, n + 3, F.lit(1), n).alias("detail"))


@query("""
WITH m AS (SELECT o_orderkey AS k, o_orderkey % 12 AS t, o_orderkey % 4 AS n, (o_orderkey % 10) / 40 AS g FROM orders), p AS (SELECT *, floor((exp(g) - 1) * 100 + 0.5)::BIGINT AS a, floor((exp(2 * g) - 1) * 100 + 0.5)::BIGINT AS b, n || ' room' || CASE WHEN n = 1 THEN '' ELSE 's' END AS r FROM m)
SELECT k, CASE WHEN t IN (0, 1, 2, 7) THEN 'check' WHEN t = 11 THEN NULL WHEN t = 4 THEN CASE WHEN k % 2 = 0 THEN 'check' ELSE 'note' END ELSE 'note' END AS level,
  CASE t WHEN 0 THEN 'Only ' || r || ' on' WHEN 1 THEN 'The ' || r || ' used' WHEN 2 THEN 'At this scale the traced' WHEN 3 THEN 'The scale was measured from ' || r WHEN 4 THEN 'The line you drew implies a scale about ' || a || '% from the rooms the app measured itself, which moves every area by roughly ' || b || '%.'
    WHEN 5 THEN 'Your two lines say the drawing is about ' || a || '% more' WHEN 6 THEN 'The line is only 80 px long, so a pixel of click error is about ' || a || '%.' WHEN 7 THEN 'This room is about ' || a || '% out from the ' || r || ' measured before it,'
    WHEN 8 THEN 'The scale comes from a ' || CASE k % 2 WHEN 0 THEN '12.5' ELSE '12' END || ' ft line you drew' WHEN 9 THEN 'The scale comes from two lines' WHEN 10 THEN 'This room’s outline and label are about ' || a || '% apart' END AS begins FROM p""")
def scale_details(spark: SparkSession, d: str) -> DataFrame:
    """What is said at length of a scale, as far as it depends on the numbers."""
    k = F.col("k")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % 12 + 1).cast("int"))
    source = pick("auto", "auto", "auto", "auto", "line", "line", "line", "manual", "line", "line", "manual", "manual")
    reason = F.nullif(pick("too-few-rooms", "rooms-disagree", "area-implausible", "auto-consensus", "line-vs-rooms", "scale-anisotropic", "short-line", "room-vs-project", "", "", "room-internal", "room-internal"), F.lit(""))
    level = F.when(k % 12 == 11, "ok").when((k % 12 == 4) & (k % 2 == 1), "note").otherwise(F.when(k % 12 == 10, "note").otherwise("check"))
    lines = F.when(k % 12 == 9, 2).otherwise(1)
    feet = F.when(k % 2 == 0, 12.5).otherwise(12.0)
    out = quality.scale_detail(source, level, reason, (k % 10) / 40, k % 4, F.lit(True), F.lit(80), feet, lines)
    cut = r"^(Only .*? on|The \d+ rooms? used|At this scale the traced|The scale was measured from \d+ rooms?|The line you drew [^.]*\.|Your two lines .*% more|The line is only [^.]*\.|This room is [^,]*,|The scale comes from a [\d.]+ ft line you drew|The scale comes from two lines|This room’s outline and label are about \d+% apart)"
    return _orders(spark, d).select("k", out["level"].alias("level"), F.regexp_extract(out["detail"], cut, 1).alias("begins"))


@query(""", n AS (SELECT plan_id, line * 1000000 + part AS trace_id, row_number() OVER (PARTITION BY plan_id ORDER BY line, part) AS i, count(*) OVER (PARTITION BY plan_id) AS c FROM (SELECT DISTINCT plan_id, line, part FROM it)), g AS (SELECT *, 1 + plan_id % 3 AS gone, 1 + plan_id % 2 AS act FROM n)
SELECT plan_id, trace_id, i AS ord, CASE WHEN gone = act AND gone <= c THEN i = CASE WHEN gone = 1 THEN 2 ELSE gone - 1 END ELSE i = act END AS active FROM g WHERE i <> gone""", items=True)
def deleted_outlines(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    # the printed number is no key: from a million parts on, outlines of two lines share one
    one = V.items(spark, d).select("plan_id", F.struct("line", "part").alias("trace_id"), "line", "part").distinct()
    order = F.row_number().over(W.partitionBy("plan_id").orderBy("line", "part")).cast("bigint")
    one = one.withColumn("ord", order).withColumn("active", F.col("ord") == 1 + F.col("plan_id") % 2)
    gone = one.filter(F.col("ord") == 1 + F.col("plan_id") % 3).select("plan_id", "trace_id")
    return working.without_outline(one, gone).select("plan_id", (F.col("trace_id.line") * 1000000 + F.col("trace_id.part")).alias("trace_id"), "ord", "active")


@query("""
WITH m AS (SELECT o_orderkey AS k FROM orders)
SELECT k, CASE WHEN k % 3 = 0 THEN 60 ELSE (k % 50)::INTEGER END AS size, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 50)::INTEGER END ELSE 60 END AS parked, CASE WHEN k % 2 = 0 THEN (k % 7)::INTEGER ELSE 3 END AS restored, CASE WHEN k % 5 = 0 THEN NULL ELSE 'own' END AS image, CASE WHEN k % 5 = 0 THEN 'live' ELSE 'own' END AS unit, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END::BIGINT AS selected FROM m""")
def adopted_states(spark: SparkSession, d: str) -> DataFrame:
    """States put to use from snapshots, from being set aside, from drafts, and for saving."""
    k = F.col("k")
    size = F.when(k % 3 != 0, (k % 50).cast("int"))
    one = _orders(spark, d).select("k", size.alias("eraser_size"), F.when(k % 2 == 0, F.array(F.lit("eraser_size"))).otherwise(F.array().cast("array<string>")).alias("present"))
    parked = working.adopted(one).select("k", F.col("eraser_size").alias("parked"))
    own = F.when(k % 5 != 0, "own")
    ids = F.when(k % 4 == 3, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))
    return working.applied(one).join(parked, "k").select(
        "k", F.col("eraser_size").alias("size"), "parked", working.restored(F.lit(3), (k % 7).cast("int"), F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "x").alias("restored"),
        working.for_saving(F.lit("live"), own, "image").alias("image"), working.for_saving(F.lit("live"), own, "unit").alias("unit"), working.selected(F.when(k % 4 == 0, F.lit(2)).otherwise(F.lit(9)).cast("bigint"), ids).alias("selected"),
    )


@query("""
WITH RECURSIVE w AS (SELECT conv_id, turn, row_number() OVER () AS k, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS words FROM conversations),
s AS (SELECT *, 1 AS i, CASE WHEN len(words) = 0 THEN []::VARCHAR[] ELSE [words[1]] END AS lines FROM w UNION ALL SELECT conv_id, turn, k, words, i + 1, CASE WHEN length(lines[-1]) + 1 + length(words[i + 1]) <= 24 THEN list_append(lines[:-2], lines[-1] || ' ' || words[i + 1]) ELSE list_append(lines, words[i + 1]) END FROM s WHERE i < len(words))
SELECT conv_id, turn, array_to_string(lines, chr(10)) AS lines FROM s WHERE i >= len(words)""")
def wrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    """The texts of conversations in lines of 24 characters."""
    return V.read(spark, d, "conversations").select("conv_id", "turn", F.array_join(working.wrapped(F.col("text"), F.lit(24)), "\n").alias("lines"))
