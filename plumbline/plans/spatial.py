"""Queries on joins of outlines, labels, rooms and walls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import spatial as P
from plumbline.plans import views as V
from plumbline.plans.registry import KIND, query

_SHAPE = "line * 100.0 AS x0, (part % 50)::DOUBLE AS y0, line * 100.0 + w_ft * ppf AS x1, part % 50 + h_ft * ppf AS y1, w_ft * ppf AS w, h_ft * ppf AS h, part % 2 = 0 AS ell"
#: A label for each outline: inside its top left for most, above it for some, far off for a few.
_LABEL = "room_id AS label_id, CASE ptype WHEN 'PROMO' THEN 'below-grade' WHEN 'MEDIUM' THEN 'garage' WHEN 'LARGE' THEN NULL ELSE 'gla' END AS ltype, CASE disc % 4 WHEN 0 THEN line * 100.0 + w_ft * ppf / 4 WHEN 1 THEN line * 100.0 + w_ft * ppf / 2 WHEN 2 THEN line * 100.0 + 3 ELSE 90000 END AS lx, CASE disc % 4 WHEN 0 THEN part % 50 + h_ft * ppf / 4 WHEN 1 THEN part % 50 - 40 WHEN 2 THEN part % 50 + 4 ELSE 90000 END AS ly"


def marks(rows: DataFrame) -> DataFrame:
    k, w, h, y0, x0 = F.col("disc") % 4, F.col("w_ft") * F.col("ppf"), F.col("h_ft") * F.col("ppf"), F.col("part") % 50, F.col("line") * 100.0
    kind = F.when(F.col("ptype") == "PROMO", "below-grade").when(F.col("ptype") == "MEDIUM", "garage").when(F.col("ptype") != "LARGE", "gla")
    x = F.when(k == 0, x0 + w / 4).when(k == 1, x0 + w / 2).when(k == 2, x0 + 3).otherwise(F.lit(90000.0))
    y = F.when(k == 0, y0 + h / 4).when(k == 1, (y0 - 40).cast("double")).when(k == 2, (y0 + 4).cast("double")).otherwise(F.lit(90000.0))
    return rows.select("plan_id", F.col("room_id").alias("label_id"), kind.alias("type"), (x - 5).alias("x"), (y - 4).alias("y"), F.lit(10.0).alias("w"), F.lit(8.0).alias("h"))


_INSIDE = "m.lx >= t.x0 AND m.lx < t.x1 AND m.ly >= t.y0 AND m.ly < t.y1 AND NOT (t.ell AND m.lx >= t.x0 + t.w / 2 AND m.ly >= t.y0 + t.h / 2)"


@query(f""", t AS (SELECT plan_id, room_id, {_SHAPE} FROM di), m AS (SELECT plan_id, {_LABEL} FROM di WHERE ptype <> 'LARGE'),
p AS (SELECT m.plan_id, m.label_id, m.ltype, t.room_id, t.w * t.h AS size, {_INSIDE} AS inside, m.lx >= t.x0 - 0.1 * t.w AND m.lx <= t.x1 + 0.1 * t.w AND greatest(t.y0 - (m.ly + 4), m.ly - 4 - t.y1, 0) <= 48 AS near FROM m JOIN t USING (plan_id)),
l AS (SELECT plan_id, label_id, ltype, arg_min(room_id, (size, room_id)) FILTER (WHERE inside) AS host, count(*) FILTER (WHERE near) AS n, min(room_id) FILTER (WHERE near) AS title FROM p GROUP BY ALL),
s AS (SELECT plan_id, ltype, host IS NOT NULL AS held, coalesce(host, CASE WHEN n = 1 THEN title END) AS trace_id FROM l), v AS (SELECT plan_id, trace_id, held, ltype, count(*) AS n FROM s WHERE trace_id IS NOT NULL GROUP BY ALL),
b AS (SELECT *, bool_or(held) OVER w AS best FROM v WINDOW w AS (PARTITION BY plan_id, trace_id)), c AS (SELECT *, max(n) OVER (PARTITION BY plan_id, trace_id) AS top FROM b WHERE held = best)
SELECT plan_id, trace_id, any_value(ltype) AS type, CASE WHEN any_value(held) THEN 'inside' ELSE 'title' END AS evidence FROM c WHERE n = top GROUP BY plan_id, trace_id HAVING count(*) = 1""", items=True)
def classify_traces(spark: SparkSession, d: str) -> DataFrame:
    rows = V.distinct_items(spark, d)
    return P.classify(V.as_traces(rows).select("plan_id", F.col("room_id").alias("trace_id"), "ring"), marks(rows))


@query(f""", t AS (SELECT plan_id, room_id, {KIND} AS kind, {_SHAPE} FROM di),
v AS (SELECT plan_id, room_id, ell, unnest(CASE WHEN ell THEN [x0, x1, x1, x0 + w / 2, x0 + w / 2, x0] ELSE [x0, x1, x1, x0] END) AS lx, unnest(CASE WHEN ell THEN [y0, y0, y0 + h / 2, y0 + h / 2, y1, y1] ELSE [y0, y0, y1, y1] END) AS ly FROM t WHERE kind <> 'gla'),
p AS (SELECT m.plan_id, m.room_id AS inner_id, t.room_id AS outer_id, avg(CASE WHEN {_INSIDE} THEN 1.0 ELSE 0 END) AS share FROM v m JOIN t ON t.plan_id = m.plan_id AND t.kind = 'gla' GROUP BY ALL)
SELECT plan_id, inner_id, min(outer_id) AS outer_id FROM p WHERE share >= 0.9 GROUP BY ALL""", items=True)
def double_counted(spark: SparkSession, d: str) -> DataFrame:
    t = V.as_traces(V.distinct_items(spark, d))
    return P.double_counted(t.select("plan_id", F.col("room_id").alias("trace_id"), "type", "ring"))


@query(f""", r AS (SELECT plan_id, room_id, line % 6 = 0 AS porch, {_SHAPE} FROM di), m AS (SELECT plan_id, {_LABEL} FROM di WHERE tax = 3)
SELECT plan_id, room_id FROM r WHERE porch OR EXISTS (SELECT 1 FROM m WHERE m.plan_id = r.plan_id AND r.x0 < m.lx + 5 AND m.lx - 5 < r.x1 AND r.y0 < m.ly + 4 AND m.ly - 4 < r.y1)""", items=True)
def non_living_rooms(spark: SparkSession, d: str) -> DataFrame:
    rows = V.distinct_items(spark, d)
    box = geom.bounds(F.col("ring"))
    rooms = V.as_traces(rows).select("plan_id", "room_id", F.when(F.col("line") % 6 == 0, "Front PORCH").otherwise("Bath").alias("name"), *[box[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    return P.non_living_rooms(rooms, marks(rows.filter("tax = 3"))).select("plan_id", "room_id")


@query(""", w AS (SELECT plan_id, room_id AS wall_id, unnest([line * 100.0 - tax, line * 100.0 + tax])::DOUBLE AS face, (part % 50)::DOUBLE AS lo, part % 50 + h_ft * 10 AS hi FROM di), p AS (SELECT plan_id, room_id AS point_id, line * 100.0 + disc * 3 - 15 AS pos, 20.0 AS a, 60.0 + w_ft AS b FROM di),
j AS (SELECT p.plan_id, p.point_id, w.wall_id, w.face, abs(p.pos - w.face) AS gap, least(p.b, w.hi) - greatest(p.a, w.lo) AS shared FROM p JOIN w USING (plan_id) WHERE least(p.b, w.hi) - greatest(p.a, w.lo) > 0 AND abs(p.pos - w.face) <= 12)
SELECT plan_id, point_id, arg_min(wall_id, (gap, -shared, wall_id, face)) AS wall_id, arg_min(face, (gap, -shared, wall_id, face)) AS face FROM j GROUP BY ALL""", items=True)
def nearest_wall(spark: SparkSession, d: str) -> DataFrame:
    rows = V.distinct_items(spark, d)
    at, y0 = F.col("line") * 100.0, (F.col("part") % 50).cast("double")
    walls = rows.select("plan_id", F.col("room_id").alias("wall_id"), (at - F.col("tax")).alias("face_lo"), (at + F.col("tax")).alias("face_hi"), y0.alias("lo"), (y0 + F.col("h_ft") * 10).alias("hi"))
    points = rows.select("plan_id", F.col("room_id").alias("point_id"), (at + F.col("disc") * 3 - 15).alias("pos"), F.lit(20.0).alias("a"), (F.lit(60.0) + F.col("w_ft")).alias("b"))
    return P.nearest_wall(points, walls, 12.0)


@query(f""", t AS (SELECT plan_id, room_id, {_SHAPE} FROM di), v AS (SELECT plan_id, room_id, unnest(CASE WHEN ell THEN [x0, x1, x1, x0 + w / 2, x0 + w / 2, x0] ELSE [x0, x1, x1, x0] END) AS x, unnest(CASE WHEN ell THEN [y0, y0, y0 + h / 2, y0 + h / 2, y1, y1] ELSE [y0, y0, y1, y1] END) AS y,
  unnest(range(0, CASE WHEN ell THEN 6 ELSE 4 END)) AS i, CASE WHEN ell THEN 6 ELSE 4 END AS n FROM t)
SELECT plan_id, room_id AS trace_id, i, x, y, coalesce(lag(x) OVER w, last_value(x) OVER a) AS prev_x, coalesce(lag(y) OVER w, last_value(y) OVER a) AS prev_y, coalesce(lead(x) OVER w, first_value(x) OVER a) AS next_x, coalesce(lead(y) OVER w, first_value(y) OVER a) AS next_y
FROM v WINDOW w AS (PARTITION BY plan_id, room_id ORDER BY i), a AS (PARTITION BY plan_id, room_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", items=True)
def vertex_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(V.as_traces(V.distinct_items(spark, d)).select("plan_id", F.col("room_id").alias("trace_id"), "ring"))


@query(""", v AS (SELECT plan_id, room_id AS i, w_ft * 4 AS x, h_ft * 4 AS y FROM di), g AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n, sqrt((x - least(greatest(x, 20), 120)) ** 2 + (y - 100) ** 2) AS gap FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY gap, i) AS r FROM g) SELECT plan_id, i, x, y FROM r WHERE gap > 60 OR r > n - 3""", items=True)
def erased_vertices(spark: SparkSession, d: str) -> DataFrame:
    v = V.distinct_items(spark, d).select("plan_id", F.col("room_id").alias("i"), (F.col("w_ft") * 4).alias("x"), (F.col("h_ft") * 4).alias("y"))
    path = v.select("plan_id").distinct().select("plan_id", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(float(x)).alias("x")) for k, x in enumerate((20, 70, 120))])).alias("p")).select("plan_id", "p.ord", "p.x", F.lit(100.0).alias("y"))
    return P.erased(v, path, 60.0)


@query(""", h AS (SELECT plan_id, CASE WHEN part % 3 > 0 THEN 'r' || part END AS label, w_ft AS x, h_ft AS y, 'held' AS source FROM di WHERE line <= 3), n AS (SELECT plan_id, CASE WHEN part % 3 > 0 THEN 'r' || part END AS label, w_ft AS x, h_ft AS y, 'new' AS source FROM di WHERE line > 3)
SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.plan_id = h.plan_id AND (n.label = h.label OR (n.label IS NULL AND abs(n.x - h.x) <= 4 AND abs(n.y - h.y) <= 4))) UNION ALL SELECT * FROM n""", items=True)
def merged_rooms(spark: SparkSession, d: str) -> DataFrame:
    r = V.distinct_items(spark, d).select("plan_id", "line", F.when(F.col("part") % 3 > 0, F.concat(F.lit("r"), F.col("part"))).alias("label"), F.col("w_ft").alias("x"), F.col("h_ft").alias("y"))
    part = lambda c, s: r.filter(c).drop("line").withColumn("source", F.lit(s))
    return P.merge_rooms(part("line <= 3", "held"), part("line > 3", "new"))


@query(""", f AS (SELECT DISTINCT plan_id, line AS floor FROM it), w AS (SELECT plan_id, room_id, CASE WHEN disc = 0 THEN 'result' ELSE 'floor' END AS scope, [line, line + 1] AS named FROM di WHERE tax < 2)
SELECT w.plan_id, f.floor, w.room_id::VARCHAR AS code, w.scope FROM w JOIN f ON f.plan_id = w.plan_id AND (w.scope = 'result' OR list_contains(w.named, f.floor))""", items=True)
def fanned_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = V.distinct_items(spark, d)
    floors = rows.select("plan_id", F.col("line").alias("floor")).distinct()
    w = rows.filter("tax < 2").select("plan_id", F.col("room_id").cast("string").alias("code"), F.when(F.col("disc") == 0, "result").otherwise("floor").alias("scope"), F.array("line", F.col("line") + 1).alias("named"))
    return P.fan_out(w, floors)


_OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@query(f""", t AS (SELECT plan_id, room_id, {_SHAPE} FROM di), c AS (SELECT a.plan_id, a.room_id, count(*) AS n FROM t a JOIN t b ON a.plan_id = b.plan_id AND a.room_id <> b.room_id AND {_OVER} / least(a.w * a.h, b.w * b.h) > 0.65 GROUP BY ALL)
SELECT t.plan_id, t.room_id AS box_id, coalesce(c.n, 0) AS twins FROM t LEFT JOIN c USING (plan_id, room_id)""", items=True)
def box_twins(spark: SparkSession, d: str) -> DataFrame:
    t = V.as_traces(V.distinct_items(spark, d))
    return P.twins(t.select("plan_id", F.col("room_id").alias("box_id"), geom.bounds(F.col("ring")).alias("box")))


@query(f""", t AS (SELECT plan_id, room_id, disc, {_SHAPE} FROM di)
SELECT a.plan_id, a.room_id AS box_id FROM t a WHERE a.disc > 2 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.disc <= 2 AND a.plan_id = b.plan_id AND {_OVER} / (a.w * a.h) > 0.4)""", items=True)
def uncovered_boxes(spark: SparkSession, d: str) -> DataFrame:
    t = V.as_traces(V.distinct_items(spark, d)).select("plan_id", F.col("room_id").alias("box_id"), "disc", geom.bounds(F.col("ring")).alias("box"))
    return P.uncovered(t.filter("disc > 2").drop("disc"), t.filter("disc <= 2").drop("disc"), 0.4).select("plan_id", "box_id")
