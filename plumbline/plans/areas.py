"""Queries on areas, outlines, units and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import checksums, geom, labels, quality, units
from plumbline.operators import area
from plumbline.plans import views as V
from plumbline.plans.registry import KIND, query

#: Square feet of an item's outline, less its hole.
NET = "w_ft * h_ft * CASE WHEN part % 2 = 0 THEN 0.75 ELSE 1 END - CASE WHEN disc > 5 AND tax <= 6 THEN w_ft * h_ft / 16 ELSE 0 END"


@query(f""", t AS (SELECT plan_id, {KIND} AS type, {NET} AS a FROM it WHERE flag <> 'R')
SELECT plan_id, type, round(sum(a), 4) AS area, count(*) AS n, grouping_id(plan_id, type)::BIGINT AS grouping FROM t GROUP BY GROUPING SETS ((plan_id, type), (plan_id), (type), ())""", items=True)
def area_by_type(spark: SparkSession, d: str) -> DataFrame:
    return area.area_by_type(V.traces(spark, d)).withColumn("area", F.round("area", 4))


@query(f""", t AS (SELECT plan_id, {KIND} AS type, sum({NET}) AS a FROM it WHERE flag <> 'R' GROUP BY ALL),
s AS (SELECT plan_id, type, CASE WHEN a > 0 THEN floor(round(a, 6) + 0.5) ELSE 0 END AS ft, CASE WHEN round(a, 6) * (0.3048 * 0.3048) >= 1 THEN floor(round(a, 6) * (0.3048 * 0.3048) + 0.5) ELSE floor(round(a, 6) * (0.3048 * 0.3048) * 100 + 0.5) / 100 END AS m FROM t)
SELECT plan_id, sum(ft)::DOUBLE AS shown, coalesce(sum(ft) FILTER (WHERE type = 'gla'), 0)::DOUBLE AS gla, round(sum(m), 2) AS shown_metric FROM s GROUP BY plan_id""", items=True)
def shown_totals(spark: SparkSession, d: str) -> DataFrame:
    t = V.traces(spark, d)
    metric = area.shown_totals(t, "metric").select("plan_id", F.round("shown", 2).alias("shown_metric"))
    return area.shown_totals(t, "decimal").join(metric, "plan_id")


@query(f""", t AS (SELECT plan_id, {KIND} AS type, sum({NET}) AS a FROM it WHERE flag <> 'R' GROUP BY ALL)
SELECT plan_id % 6 <> 1 AS from_disk, type, count(DISTINCT plan_id) AS plans, round(sum(a), 4) AS area FROM t WHERE plan_id IN (SELECT plan_id FROM t GROUP BY plan_id HAVING sum(a) > 0) GROUP BY ALL""", items=True)
def workspace_area(spark: SparkSession, d: str) -> DataFrame:
    t = V.traces(spark, d)
    live = t.select("plan_id").filter("plan_id % 6 = 1").distinct()
    return area.workspace(t, live).withColumn("area", F.round("area", 4))


@query(""", m AS (SELECT plan_id, line, part, line * 100.0 AS x0, (part % 50)::DOUBLE AS y0, w_ft * ppf AS w, h_ft * ppf AS h, CASE WHEN part % 7 = 3 THEN 'bow' WHEN part % 7 = 4 THEN 'two' WHEN part % 2 = 0 THEN 'ell' ELSE 'box' END AS k, part % 5 = 0 AND part % 7 NOT IN (3, 4) AS back FROM it)
SELECT plan_id, line, part, CASE k WHEN 'ell' THEN w * h * 0.75 WHEN 'box' THEN w * h ELSE 0 END * CASE WHEN back THEN -1 ELSE 1 END AS signed_area, round(CASE k WHEN 'bow' THEN 2 * sqrt(w * w + h * h) + 2 * h WHEN 'two' THEN 2 * w ELSE 2 * (w + h) END, 6) AS perimeter,
  round(x0 + w * CASE WHEN k = 'ell' THEN 5.0 / 12 ELSE 0.5 END, 4) AS cx, round(y0 + h * CASE k WHEN 'ell' THEN 5.0 / 12 WHEN 'two' THEN 0 ELSE 0.5 END, 4) AS cy, x0::DOUBLE AS min_x, CASE k WHEN 'two' THEN y0 ELSE y0 + h END AS max_y,
  CASE WHEN k IN ('bow', 'two') THEN 'degenerate' WHEN back THEN 'CCW' ELSE 'CW' END AS winding, k = 'bow' AS crosses FROM m""", items=True)
def trace_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles and Ls wound either way, bows that cross themselves, and outlines of two corners."""
    k = F.col("part") % 7
    at = lambda i: F.get("ring", F.lit(i))
    low, right = F.array_max(F.transform("ring", lambda p: p["y"])), F.array_max(F.transform("ring", lambda p: p["x"]))
    bow = F.array(at(0), geom.point(right, low), geom.point(right, at(0)["y"]), geom.point(at(0)["x"], low))
    ring = F.when(k == 3, bow).when(k == 4, F.slice("ring", 1, 2)).when(F.col("part") % 5 == 0, F.reverse("ring")).otherwise(F.col("ring"))
    one = V.traces(spark, d).select("plan_id", "line", "part", ring.alias("ring"))
    r = F.col("ring")
    c, b = geom.centroid(r), geom.bounds(r)
    return one.select(
        "plan_id", "line", "part", geom.signed_area(r).alias("signed_area"), F.round(geom.perimeter(r), 6).alias("perimeter"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"),
        b["x0"].alias("min_x"), b["y1"].alias("max_y"), geom.winding(r).alias("winding"), geom.self_intersects(r).alias("crosses"),
    )


@query(""", m AS (SELECT plan_id, line, part, CASE WHEN part % 2 = 0 THEN 6 ELSE 4 END AS n, part % 7 AS k FROM it)
SELECT plan_id, line, part, CASE WHEN k % 3 = 0 THEN 'CW' ELSE 'CCW' END AS before, 'CCW' AS after FROM m""", items=True)
def ring_winding(spark: SparkSession, d: str) -> DataFrame:
    ring = F.when(F.col("part") % 7 % 3 == 0, F.col("ring")).otherwise(F.reverse("ring"))
    return V.traces(spark, d).select("plan_id", "line", "part", geom.winding(ring).alias("before"), geom.winding(geom.wound(ring)).alias("after"))


@query(""", m AS (SELECT plan_id, line, part, disc, part % 5 AS k FROM it)
SELECT plan_id, line, part, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'The void must sit inside the outline' WHEN 2 THEN 'The void crosses itself' WHEN 3 THEN 'The void overlaps another void' ELSE 'A void needs at least three corners' END AS refusal FROM m""", items=True)
def void_rules(spark: SparkSession, d: str) -> DataFrame:
    """A void in each outline's first quarter: good, moved outside, folded, doubled, or with two corners."""
    w, h, x0, y0 = F.col("w_ft") * F.col("ppf"), F.col("h_ft") * F.col("ppf"), F.col("line") * 100.0, (F.col("part") % 50).cast("double")
    a, b, c, e = x0 + w / 8, y0 + h / 8, x0 + w * 3 / 8, y0 + h * 3 / 8
    good = V.rectangle(a, b, c, e)
    k = F.col("part") % 5
    ring = (
        F.when(k == 1, V.rectangle(a + 4 * w, b, c + 4 * w, e))
        .when(k == 2, F.array(geom.point(a, b), geom.point(c, e), geom.point(c, b), geom.point(a, e)))
        .when(k == 4, F.slice(good, F.lit(1), F.lit(2)))
        .otherwise(good)
    )
    others = F.when(k == 3, F.array(V.rectangle(a + w / 16, b + h / 16, c + w / 16, e + h / 16))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    return V.traces(spark, d).select("plan_id", "line", "part", geom.void_refusal(ring, F.col("ring"), others).alias("refusal"))


@query(""", m AS (SELECT *, CASE WHEN disc > 5 THEN 1 ELSE 0 END AS n, part % 3 = 0 AS own, tax > 6 AS old FROM it)
SELECT plan_id, line, part, n AS holes, CASE WHEN n = 1 AND (old AND NOT own) THEN 1 ELSE 0 END AS stale, CASE WHEN n = 1 AND own THEN 1 ELSE 0 END AS kept FROM m""", items=True)
def stale_holes(spark: SparkSession, d: str) -> DataFrame:
    """User holes are judged anew against the outline, others keep their mark; merging keeps user holes and takes new ones."""
    no = F.array().cast("array<array<struct<x:double,y:double>>>")
    marked = F.transform("holes", lambda h: F.when(h["source"] == "user", geom.void_refusal(h["ring"], F.col("ring"), no).isNotNull()).otherwise(h["stale"]))
    return V.traces(spark, d).select(
        "plan_id", "line", "part", F.size("holes").alias("holes"), F.size(F.filter(marked, lambda x: x)).alias("stale"), F.size(F.filter("holes", lambda h: h["source"] == "user")).alias("kept")
    )


_FI = "(floor(w) * 12 + floor((w - floor(w)) * 12 + 0.5))::BIGINT"


@query(f""", m AS (SELECT plan_id, line, part, w_ft + part % 24 / 24.0 + 0.01 * disc AS w, part % 3 AS u, line % 3 AS s FROM it), f AS (SELECT *, {_FI} // 12 AS feet, {_FI} % 12 AS inches, w * 0.3048 AS met FROM m)
SELECT plan_id, line, part, feet, inches, CASE u
    WHEN 0 THEN CASE s WHEN 0 THEN feet || ' ft ' || inches || ' in' WHEN 1 THEN feet || ''' ' || inches || '"' ELSE feet || '''' || inches || '"' END
    WHEN 1 THEN printf('%.2f', floor(met * 100 + 0.5) / 100) || CASE s WHEN 0 THEN ' meters' ELSE ' m' END
    ELSE printf('%.1f', floor(w * 10 + 0.5) / 10) || CASE s WHEN 0 THEN '''' WHEN 1 THEN '' ELSE ' ft' END END AS length,
  CASE u WHEN 0 THEN feet || ''' ' || inches || '"' WHEN 1 THEN printf('%.2f', floor(met * 100 + 0.5) / 100) ELSE printf('%.1f', floor(w * 10 + 0.5) / 10) END AS input,
  CASE WHEN u = 1 THEN CASE WHEN w * h * 0.09290304 >= 1 THEN format('{{:,}}', floor(w * h * (0.3048 * 0.3048) + 0.5)::BIGINT) ELSE printf('%.2f', floor(w * h * (0.3048 * 0.3048) * 100 + 0.5) / 100) END ELSE format('{{:,}}', floor(w * h + 0.5)::BIGINT) END AS area,
  CASE WHEN u = 1 THEN 'm²' ELSE 'ft²' END AS suffix, round(feet + inches / 12.0, 6) AS back, round(met / 0.3048, 6) AS feet_again
FROM (SELECT *, w * 37 AS h FROM f)""", items=True)
def units_written(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w_ft") + F.col("part") % 24 / 24.0 + 0.01 * F.col("disc")
    u, s = F.col("part") % 3, F.col("line") % 3
    unit = F.when(u == 0, "inches").when(u == 1, "metric").otherwise("decimal")
    style = F.when(u == 0, F.when(s == 0, "explicit").when(s == 1, "tick-space").otherwise("tick")).when(u == 1, F.when(s == 0, "meters").otherwise("m")).otherwise(F.when(s == 0, "tick").when(s == 1, "bare").otherwise("ft"))
    one = V.items(spark, d).select("plan_id", "line", "part", w.alias("w"), unit.alias("unit"), style.alias("style"))
    fi, a = units.feet_inches(F.col("w")), units.format_area(F.col("w") * (F.col("w") * 37), F.col("unit"))
    return one.select(
        "plan_id", "line", "part", fi["feet"].alias("feet"), fi["inches"].alias("inches"), units.format_length(F.col("w"), F.col("unit"), F.col("style")).alias("length"), units.dimension_input(F.col("w"), F.col("unit")).alias("input"),
        a["value"].alias("area"), a["suffix"].alias("suffix"), F.round(units.from_feet_inches(fi["feet"], fi["inches"]), 6).alias("back"), F.round(units.from_meters(units.to_meters(F.col("w"))), 6).alias("feet_again"),
    )


@query("""
WITH m AS (SELECT o_orderkey, o_orderkey % 14 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 7, 13) THEN 'below-grade' WHEN k IN (1, 5, 10) THEN 'gla' END AS type,
  CASE k WHEN 0 THEN 'basement' WHEN 7 THEN 'lower lvl' WHEN 13 THEN 'garden level' WHEN 1 THEN '2nd floor' WHEN 5 THEN 'main level' WHEN 10 THEN 'floor 3' END AS keyword,
  CASE k WHEN 2 THEN 'garage' WHEN 6 THEN 'sundeck' WHEN 9 THEN 'swimmingpool' WHEN 12 THEN 'porch' END AS exterior FROM m""")
def label_words(spark: SparkSession, d: str) -> DataFrame:
    text = V.label_text(F.col("o_orderkey"))
    hit = labels.area_label(text)
    return V.read(spark, d, "orders").select("o_orderkey", hit["type"].alias("type"), hit["keyword"].alias("keyword"), labels.exterior_feature(text).alias("exterior"))


_HEX = "printf('#%02X%02X%02X', {0}, {1}, {2})"
_MIX = "CASE WHEN k < 0 THEN floor({c} * (1 + k) + 0.5) ELSE floor({c} + (255 - {c}) * k + 0.5) END::INTEGER"


@query(f""", c AS (SELECT *, {KIND} AS t FROM di), n AS (SELECT *, row_number() OVER (PARTITION BY plan_id, t ORDER BY room_id) - 1 AS nth FROM c),
k AS (SELECT *, [0.0, -0.22, 0.30, -0.44, 0.55][nth % 5 + 1]::DOUBLE AS k, CASE t WHEN 'gla' THEN [189, 147, 249] WHEN 'below-grade' THEN [139, 233, 253] WHEN 'garage' THEN [255, 184, 108] WHEN 'porch' THEN [80, 250, 123] ELSE [241, 250, 140] END AS rgb FROM n)
SELECT plan_id, room_id, nth, CASE WHEN part % 4 = 0 THEN '#123456' ELSE {_HEX.format(*[_MIX.format(c=f'rgb[{i}]') for i in (1, 2, 3)])} END AS color,
  CASE t WHEN 'gla' THEN 'GLA' WHEN 'below-grade' THEN 'Below grade' WHEN 'garage' THEN 'Garage' WHEN 'porch' THEN 'Porch/patio' ELSE 'Unfinished' END AS label FROM k""", items=True)
def trace_colors(spark: SparkSession, d: str) -> DataFrame:
    t = V.as_traces(V.distinct_items(spark, d)).select("plan_id", "room_id", "type", F.when(F.col("part") % 4 == 0, "user").otherwise("type").alias("color_source"), F.lit("#123456").alias("color"))
    return area.colored(t, "room_id").select("plan_id", "room_id", F.col("nth").cast("bigint").alias("nth"), "color", labels.type_label(F.col("type")).alias("label"))


_NAME = "CASE line % 5 WHEN 0 THEN '3rd Floor' WHEN 1 THEN '1st Floor' WHEN 2 THEN 'Garage' WHEN 3 THEN 'Garage 2' ELSE 'Attic' END"


@query(f""", n AS (SELECT plan_id, {_NAME} AS name FROM it), g AS (SELECT plan_id, greatest(coalesce(max(CASE name WHEN '3rd Floor' THEN 3 WHEN '1st Floor' THEN 1 END), 0), count(*)) + 1 AS n, bool_or(name = 'Garage') AS g1, bool_or(name = 'Garage 2') AS g2 FROM n GROUP BY plan_id)
SELECT plan_id, n || CASE n WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END || ' Floor' AS storey, CASE WHEN NOT g1 THEN 'Garage' WHEN NOT g2 THEN 'Garage 2' ELSE 'Garage 3' END AS garage FROM g""", items=True)
def next_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("line") % 5
    name = F.when(k == 0, "3rd Floor").when(k == 1, "1st Floor").when(k == 2, "Garage").when(k == 3, "Garage 2").otherwise("Attic")
    names = V.items(spark, d).select("plan_id", name.alias("name"))
    return area.next_name(names, "gla").withColumnRenamed("next_name", "storey").join(area.next_name(names, "garage").withColumnRenamed("next_name", "garage"), "plan_id")


@query("""
WITH m AS (SELECT o_orderkey AS k, o_orderkey % 6 AS a, o_orderkey % 4 AS b, o_orderkey % 3 AS c FROM orders)
SELECT k, CASE WHEN a IN (0, 4, 5) THEN 'gla' WHEN a = 1 THEN 'garage' WHEN a = 2 THEN 'porch' ELSE 'unfinished' END AS type,
  CASE WHEN c = 0 THEN 'user' WHEN a IN (0, 4, 5) THEN 'auto' ELSE 'user' END AS type_source, CASE WHEN c = 1 THEN 'type' WHEN a = 5 THEN 'user' ELSE 'type' END AS color_source,
  CASE WHEN b IN (0, 1) THEN 'auto' ELSE 'user' END AS name_source FROM m""")
def trace_migration(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.element_at(F.array(*[F.lit(x).cast("string") for x in ("gla", "garage", "porch", "unfinished", "ATTIC", None)]), (k % 6 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("2nd Floor", " Garage 12 ", "Attic", "Garage x")]), (k % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    rules = labels.rule_columns(F.when(k % 3 == 1, "type"), F.when(k % 3 == 0, "user"), none, t, name)
    return V.read(spark, d, "orders").select(k.alias("k"), *[v.alias(n) for n, v in rules.items()])


@query("""
WITH m AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS s FROM part), l AS (SELECT *, s || '|' || length(s) AS t FROM m)
SELECT p_partkey, printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(t) + 1), lambda i: unicode(t[i])::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS image_key,
  list_reduce(list_prepend(1::BIGINT, list_transform(range(1, length(s) + 1), lambda i: unicode(s[i])::BIGINT)), lambda h, c: (((h // 65536) + (h % 65536 + c) % 65521) % 65521) * 65536 + (h % 65536 + c) % 65521) AS adler FROM l""")
def image_keys(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return V.read(spark, d, "part").select("p_partkey", checksums.image_key(s).alias("image_key"), checksums.adler32(F.encode(s, "UTF-8")).alias("adler"))


@query("""
WITH d AS (SELECT text, min(doc_id) AS first FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text), k AS (SELECT first, substr(md5(text), 1, 6) AS bucket, text FROM d)
SELECT first AS doc_id, bucket, CASE WHEN row_number() OVER w = 1 THEN bucket ELSE bucket || '~' || (row_number() OVER w - 1) END AS intern_key FROM k WINDOW w AS (PARTITION BY bucket ORDER BY first)""")
def intern_keys(spark: SparkSession, d: str) -> DataFrame:
    """Payloads kept once each, by a short hash; the few that share one get a suffix by first use. Empty texts are no payloads."""
    from pyspark.sql import Window as W

    each = V.read(spark, d, "documents").filter("text <> ''").select("doc_id", F.sha2("text", 256).alias("payload"), F.substring(F.md5("text"), 1, 6).alias("bucket"))
    one = each.groupBy("payload", "bucket").agg(F.min("doc_id").alias("doc_id"))
    n = F.row_number().over(W.partitionBy("bucket").orderBy("doc_id")) - 1
    return one.withColumn("n", n).select("doc_id", "bucket", F.when(F.col("n") == 0, F.col("bucket")).otherwise(F.concat("bucket", F.lit("~"), F.col("n").cast("string"))).alias("intern_key"))


@query("""
WITH c AS (SELECT unnest(['no-boundary', 'wall-left-outside', 'remediated', 'odd-code']) AS code, unnest([0, 9, 22, 999]) AS r, unnest(['No outline traced', 'Wall left outside', 'Traced again', 'Odd code']) AS label, unnest(['result', 'floor', 'result', 'floor']) AS scope),
w AS (SELECT user_id, event_id, code, label, scope, event_type, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'warn' END AS severity, r FROM events JOIN c ON c.code = ['no-boundary', 'wall-left-outside', 'remediated', 'odd-code'][event_id % 4 + 1]),
x AS (SELECT *, CASE WHEN severity = 'error' THEN 0 ELSE 1000 END + r AS rank FROM w)
SELECT user_id, event_id, code, severity, label, scope, rank::BIGINT AS rank, row_number() OVER (PARTITION BY user_id ORDER BY rank, event_id) AS place FROM x""")
def ranked_warnings(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    code = F.element_at(F.array(*[F.lit(x) for x in ("no-boundary", "wall-left-outside", "remediated", "odd-code")]), (F.col("event_id") % 4 + 1).cast("int"))
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info").otherwise("warn")
    w = V.read(spark, d, "events").select("user_id", "event_id", code.alias("code"), severity.alias("severity"))
    w = w.withColumns({"label": quality.short_name(F.col("code")), "scope": quality.scope(F.col("code"), F.lit(None).cast("string")), "rank": quality.rank(F.col("severity"), F.col("code"))})
    return w.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("rank", "event_id")).cast("bigint"))


@query("""
WITH e AS (SELECT event_id, least(greatest(value / 20, -0.1), 1.2) AS c, value, ['auto', 'line', 'manual'][event_id % 3 + 1] AS source, ['too-few-rooms', 'rooms-disagree', 'line-vs-rooms', 'short-line', 'room-vs-project', NULL][event_id % 6 + 1] AS reason, event_id % 2 = 0 AS adopted, (event_id % 5)::INTEGER AS rooms FROM events),
p AS (SELECT *, floor((exp(value / 100) - 1) * 100 + 0.5)::BIGINT AS apart, floor((exp(2 * (value / 100)) - 1) * 100 + 0.5)::BIGINT AS areas, rooms || ' room' || CASE WHEN rooms = 1 THEN '' ELSE 's' END AS n FROM e)
SELECT event_id, CASE WHEN c >= 0.75 THEN 'good' WHEN c >= 0.5 THEN 'fair' WHEN c > 0 THEN 'poor' ELSE 'failed' END AS level,
  CASE WHEN source = 'auto' AND coalesce(reason, '') <> 'room-vs-project' THEN CASE reason WHEN 'rooms-disagree' THEN 'Rooms disagree by ~' || apart || '%' ELSE 'Scale from ' || n END
    WHEN source = 'line' THEN CASE reason WHEN 'line-vs-rooms' THEN 'Scale set by hand, areas ~' || areas || '% different' WHEN 'short-line' THEN 'Scale set by hand from a short line' ELSE 'Scale set by hand' END
    WHEN reason = 'room-vs-project' THEN CASE WHEN adopted THEN 'This room disagrees with the last one' ELSE 'Kept the scale from earlier rooms' END END AS short FROM p""")
def quality_texts(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    at = lambda xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    source, reason = at(["auto", "line", "manual"]), at(["too-few-rooms", "rooms-disagree", "line-vs-rooms", "short-line", "room-vs-project", None])
    c = F.least(F.greatest(F.col("value") / 20, F.lit(-0.1)), F.lit(1.2))
    return e.select("event_id", quality.level(c).alias("level"), quality.scale_short(source, F.lit("check"), reason, F.col("value") / 100, (F.col("event_id") % 5).cast("int"), F.col("event_id") % 2 == 0).alias("short"))
