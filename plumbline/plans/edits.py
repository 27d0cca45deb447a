"""Queries on edits and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import editing as E
from plumbline.plans import rasters
from plumbline.plans import views as V
from plumbline.plans.registry import KIND, query


@query(f""", t AS (SELECT plan_id, room_id, {KIND} AS type, part % 5 = 0 AS own, tax FROM di) SELECT plan_id, room_id AS trace_id, CASE WHEN own THEN type WHEN tax < 3 THEN 'garage' ELSE 'gla' END AS new_type FROM t""", items=True)
def applied_verdicts(spark: SparkSession, d: str) -> DataFrame:
    t = V.as_traces(V.distinct_items(spark, d)).select("plan_id", F.col("room_id").alias("trace_id"), "type", F.when(F.col("part") % 5 == 0, "user").otherwise("auto").alias("type_source"), "tax")
    v = t.filter("tax < 3").select("plan_id", "trace_id", F.lit("garage").alias("type"))
    return E.apply_verdicts(t, v).select("plan_id", "trace_id", "new_type")


@query(""", h AS (SELECT plan_id, room_id, row_number() OVER (PARTITION BY plan_id ORDER BY room_id) AS ord, disc FROM di), k AS (SELECT plan_id, count(*) AS n, count(*) FILTER (WHERE disc > 0) AS m FROM h GROUP BY plan_id), w AS (SELECT plan_id, room_id, row_number() OVER (PARTITION BY plan_id ORDER BY room_id) AS ord FROM di WHERE disc > 0)
SELECT w.plan_id, w.ord, CASE WHEN k.n = k.m THEN 'held ' || h.room_id ELSE 'new ' || w.room_id END AS trace_id FROM w JOIN k USING (plan_id) LEFT JOIN h ON h.plan_id = w.plan_id AND h.ord = w.ord""", items=True)
def replaced_outlines(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("plan_id").orderBy("room_id")).cast("bigint")
    rows = V.distinct_items(spark, d)
    held = rows.select("plan_id", n.alias("ord"), F.concat(F.lit("held "), F.col("room_id")).alias("trace_id"))
    new = rows.filter("disc > 0").select("plan_id", n.alias("ord"), F.concat(F.lit("new "), F.col("room_id")).alias("new_id"), F.lit(0).alias("ring"))
    return E.replace_outlines(held, new).select("plan_id", "ord", "trace_id")


@query(""", t AS (SELECT plan_id, room_id, line * 100.0 AS x0, (part % 50)::DOUBLE AS y0, w_ft * ppf AS w, h_ft * ppf AS h, part % 2 = 0 AS ell, disc = 0 AS active FROM di), r AS (SELECT plan_id, room_id AS ring_id, line * 100.0 + 30 AS x, (part % 50)::DOUBLE + 20 AS y FROM di),
p AS (SELECT r.plan_id, ring_id, t.room_id, active, w * h * CASE WHEN ell THEN 0.75 ELSE 1 END AS s FROM r JOIN t ON t.plan_id = r.plan_id AND x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h AND NOT (ell AND x >= x0 + w / 2 AND y >= y0 + h / 2))
SELECT plan_id, ring_id, arg_min(room_id, (NOT active, s, room_id)) AS trace_id FROM p GROUP BY ALL""", items=True)
def target_outlines(spark: SparkSession, d: str) -> DataFrame:
    rows = V.distinct_items(spark, d)
    x, y = F.col("line") * 100.0 + 30, (F.col("part") % 50).cast("double") + 20
    rings = rows.select("plan_id", F.col("room_id").alias("ring_id"), V.rectangle(x - 2, y - 2, x + 2, y + 2).alias("hole"))
    return E.target_outline(V.as_traces(rows).select("plan_id", F.col("room_id").alias("trace_id"), "ring", (F.col("disc") == 0).alias("active")), rings)


@query(""", v AS (SELECT plan_id, room_id AS i, w_ft * 3 AS vx, h_ft * 3 AS vy FROM di), p AS (SELECT plan_id, room_id AS point_id, w_ft * 3 + disc AS x, h_ft * 3 - tax AS y FROM di), j AS (SELECT p.plan_id, point_id, i, sqrt((x - vx) ** 2 + (y - vy) ** 2) AS gap FROM p JOIN v USING (plan_id))
SELECT plan_id, point_id, arg_min(i, (gap, i)) AS i FROM j WHERE gap <= 9 GROUP BY ALL""", items=True)
def snapped_points(spark: SparkSession, d: str) -> DataFrame:
    rows = V.distinct_items(spark, d)
    v = rows.select("plan_id", F.col("room_id").alias("i"), (F.col("w_ft") * 3).alias("vx"), (F.col("h_ft") * 3).alias("vy"))
    p = rows.select("plan_id", F.col("room_id").alias("point_id"), (F.col("w_ft") * 3 + F.col("disc")).alias("x"), (F.col("h_ft") * 3 - F.col("tax")).alias("y"))
    return E.nearest_vertex(p, v, 9.0)


_RECT = "SELECT plan_id, k AS rect_id, k * 7 AS x0, k * 5 AS y0, k * 7 + 10 + k * 2 AS x1, k * 5 + 8 + k * 3 AS y1 FROM (SELECT DISTINCT plan_id FROM c), range(0, 20) r(k)"


def _rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("rect_id")
    plans = rasters.cells(spark, d).select("plan_id").distinct()
    r = plans.withColumn("rect_id", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<bigint>")))
    return r.select("plan_id", "rect_id", (k * 7).alias("x0"), (k * 5).alias("y0"), (k * 9 + 10).alias("x1"), (k * 8 + 8).alias("y1"))


@query(rasters._CELLS + f""", r AS ({_RECT}), s AS (SELECT *, greatest(1, floor((x1 - x0) / 24 + 0.5)::BIGINT) AS sx, greatest(1, floor((y1 - y0) / 24 + 0.5)::BIGINT) AS sy FROM r),
p AS (SELECT plan_id, rect_id, x, unnest(range(y0, y1 + 1, sy)) AS y FROM (SELECT plan_id, rect_id, y0, y1, sy, unnest(range(x0, x1 + 1, sx)) AS x FROM s))
SELECT p.plan_id, rect_id, round(avg((c.plan_id IS NOT NULL)::INTEGER), 9) AS cover FROM p LEFT JOIN c ON c.plan_id = p.plan_id AND c.x = p.x AND c.y = p.y GROUP BY p.plan_id, rect_id""")
def rect_coverage(spark: SparkSession, d: str) -> DataFrame:
    return E.rect_coverage(_rects(spark, d), rasters.runs(spark, d)).withColumn("cover", F.round("cover", 9))


@query(""", d1 AS (SELECT plan_id, room_id, w_ft / 10 AS dw, h_ft / 10 AS dh, w_ft * ppf / 10 AS bw, h_ft * ppf * (1 + tax / 200.0) / 10 AS bh, part % 4 = 0 AS own, disc, tax, ppf FROM di),
e AS (SELECT *, dw / bw AS x, dh / bh AS y FROM d1), f AS (SELECT *, abs(ln(x / y)) AS iso FROM e), g AS (SELECT *, CASE WHEN iso <= 0.05 THEN x ELSE sqrt(x * y) END AS rs FROM f), h AS (SELECT *, [1.0 / ppf, (1 + disc / 40.0) / ppf] AS o, (1 + disc / 40.0) / ppf AS up FROM g),
k AS (SELECT *, abs(ln(rs / up)) AS gap FROM h)
SELECT plan_id, room_id, CASE WHEN own THEN CASE WHEN gap > 0.22 THEN 'check' WHEN gap > 0.03 THEN 'note' WHEN iso <= 0.05 THEN 'ok' WHEN iso > 0.25 THEN 'check' ELSE 'note' END WHEN gap > 0.22 THEN 'check' WHEN iso <= 0.05 THEN 'ok' WHEN iso > 0.25 THEN 'check' ELSE 'note' END AS level, 'manual' AS source, round(rs, 9) AS sx FROM k""", items=True)
def scale_updates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("ppf")
    dims = V.distinct_items(spark, d).select(
        "plan_id", "room_id", (F.col("w_ft") / 10).alias("dw"), (F.col("h_ft") / 10).alias("dh"), (F.col("w_ft") * p / 10).alias("bw"), (F.col("h_ft") * p * (1 + F.col("tax") / 200.0) / 10).alias("bh"), F.array(1 / p, (1 + F.col("disc") / 40.0) / p).alias("others"),
        F.lit(False).alias("pinned"), F.when(F.col("part") % 4 == 0, "line").alias("source_now"), F.lit(1.0).alias("sx_now"), F.lit(1.0).alias("sy_now"), F.lit("ok").alias("level_now"),
    )
    return E.scale_update(dims).select("plan_id", "room_id", "level", "source", F.round("sx", 9).alias("sx"))


@query("""
WITH s AS (SELECT user_id AS doc_id, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'undo' ELSE 'redo' END AS stack, event_id AS seq FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stack DESC, seq DESC) AS n FROM s) SELECT doc_id, stack, seq FROM n WHERE n <= 50""")
def kept_history(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type").isin("view", "click", "error"), "undo").otherwise("redo").alias("stack"), F.col("event_id").alias("seq"))
    return E.capped_history(e)
