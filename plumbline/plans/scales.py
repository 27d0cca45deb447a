"""Queries on the scale of drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scale as S
from plumbline.operators import consensus
from plumbline.plans import views as V
from plumbline.plans.registry import query

#: A room's pixels per foot as measured: the true value, off by a little, and by much where tax is 8.
_PX = "ppf * (1 + disc / 100.0) * CASE WHEN tax = 8 THEN 1.5 ELSE 1 END"
_PY = "ppf * (1 + tax / 100.0)"


def measured(rows: DataFrame) -> DataFrame:
    off = F.when(F.col("tax") == 8, 1.5).otherwise(1.0)
    return rows.withColumns({"px": F.col("ppf") * (1 + F.col("disc") / 100.0) * off, "py": F.col("ppf") * (1 + F.col("tax") / 100.0), "confidence": 1 - F.col("disc") * 0.06})


@query(f""", s AS (SELECT plan_id, unnest([{_PX}, {_PY}]) AS v FROM it), o AS (SELECT plan_id, list_sort(list(v)) AS a FROM s GROUP BY plan_id),
m AS (SELECT *, a[len(a) // 2 + 1] AS med FROM o), k AS (SELECT *, list_filter(a, lambda v: abs(ln(v / med)) <= 0.25) AS kept FROM m)
SELECT plan_id, round(kept[len(kept) // 2 + 1], 9) AS value, round(med, 9) AS median, round(a[-1] / a[1], 9) AS spread, len(a)::BIGINT AS samples, len(kept)::BIGINT AS kept FROM k""", items=True)
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    one = measured(V.items(spark, d)).groupBy("plan_id").agg(F.flatten(F.collect_list(F.array("px", "py"))).alias("s"))
    one = one.select("plan_id", S.robust(F.col("s")).alias("r"))
    return one.select("plan_id", *[F.round(f"r.{c}", 9).alias(c) for c in ("value", "median", "spread")], F.col("r.samples").cast("bigint").alias("samples"), F.col("r.kept").cast("bigint").alias("kept"))


_BOX = "w_ft * ppf * (1 + disc / 50.0) AS bw, h_ft * ppf * (1 + tax / 100.0) AS bh, CASE WHEN part % 3 = 0 THEN h_ft ELSE w_ft END AS dw, CASE WHEN part % 3 = 0 THEN w_ft ELSE h_ft END AS dh"


@query(f""", b AS (SELECT plan_id, line, part, {_BOX} FROM it), o AS (SELECT *, abs(ln(dw / dh) - ln(bw / bh)) > 0.05 AND abs(ln(dw / dh) + ln(bw / bh)) < abs(ln(dw / dh) - ln(bw / bh)) AS swapped FROM b),
x AS (SELECT *, CASE WHEN swapped THEN dh ELSE dw END / bw AS x, CASE WHEN swapped THEN dw ELSE dh END / bh AS y FROM o)
SELECT plan_id, line, part, swapped, abs(ln(x / y)) <= 0.05 AS ok, round(CASE WHEN abs(ln(x / y)) <= 0.05 THEN x ELSE sqrt(x * y) END, 9) AS sx, round(CASE WHEN abs(ln(x / y)) <= 0.05 THEN y ELSE sqrt(x * y) END, 9) AS sy FROM x""", items=True)
def room_scales(spark: SparkSession, d: str) -> DataFrame:
    swap = F.col("part") % 3 == 0
    b = V.items(spark, d).select(
        "plan_id", "line", "part", (F.col("w_ft") * F.col("ppf") * (1 + F.col("disc") / 50.0)).alias("bw"), (F.col("h_ft") * F.col("ppf") * (1 + F.col("tax") / 100.0)).alias("bh"),
        F.when(swap, F.col("h_ft")).otherwise(F.col("w_ft")).alias("dw"), F.when(swap, F.col("w_ft")).otherwise(F.col("h_ft")).alias("dh"),
    )
    args = [F.col(c) for c in ("dw", "dh", "bw", "bh")]
    r = S.room_scale(*args, F.array().cast("array<double>"))
    return b.select("plan_id", "line", "part", S.oriented(*args)["swapped"].alias("swapped"), r["ok"].alias("ok"), F.round(r["x"], 9).alias("sx"), F.round(r["y"], 9).alias("sy"))


@query(f""", r AS (SELECT *, {_PX} AS px, {_PY} AS py, 1 - disc * 0.06 >= 0.5 AND line % 5 <> 0 AS good FROM it),
l AS (SELECT plan_id, list(struct_pack(px := px, py := py)) FILTER (WHERE good) AS rooms, count(*) AS n, coalesce(sum(w_ft * h_ft) FILTER (WHERE line % 5 <> 0), 0) AS label FROM r GROUP BY plan_id),
s AS (SELECT *, list_sort(flatten(list_transform(rooms, lambda q: [q.px, q.py]))) AS a FROM l), m AS (SELECT *, a[len(a) // 2 + 1] AS med FROM s),
k AS (SELECT *, list_filter(a, lambda v: abs(ln(v / med)) <= 0.25) AS kept, len(list_filter(rooms, lambda q: abs(ln(q.px / med)) <= 0.25 OR abs(ln(q.py / med)) <= 0.25))::BIGINT AS c FROM m),
v AS (SELECT *, kept[len(kept) // 2 + 1] AS ppf, CASE WHEN len(kept) > 1 THEN ln(kept[-1] / kept[1]) ELSE 0 END AS spread FROM k),
z AS (SELECT *, CASE WHEN label > 0 THEN (plan_id % 7) * 30000 / (ppf * ppf) / label END AS ratio FROM v),
y AS (SELECT *, CASE WHEN plan_id % 7 > 0 THEN ratio END AS r2 FROM z)
SELECT plan_id, round(ppf, 9) AS ppf, CASE WHEN med IS NULL THEN 'no-rooms' WHEN r2 < 0.7 THEN 'area-implausible' WHEN spread > 0.45 THEN 'rooms-disagree' WHEN c < 3 THEN 'too-few-rooms' ELSE 'auto-consensus' END AS reason,
  CASE WHEN med IS NOT NULL AND NOT coalesce(r2 < 0.7, false) AND spread <= 0.45 AND c >= 3 THEN 'ok' ELSE 'check' END AS level,
  coalesce(c, 0) AS room_count, round(CASE WHEN med IS NULL THEN 0 ELSE spread END, 9) AS spread, round(CASE WHEN med IS NOT NULL THEN r2 END, 6) AS area_ratio, n - coalesce(c, 0) AS rejected FROM y""", items=True)
def project_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = measured(V.items(spark, d)).select("plan_id", F.when(F.col("line") % 5 == 0, "Garage").otherwise("Bedroom").alias("name"), "px", "py", "confidence", F.col("w_ft").alias("dim_w"), F.col("h_ft").alias("dim_h"), F.lit(False).alias("outside"))
    feet = rows.select("plan_id").distinct().select("plan_id", ((F.col("plan_id") % 7) * 30000.0).alias("area_px"))
    out = consensus.select_scale(rows, feet)
    return out.withColumns({"ppf": F.round("ppf", 9), "spread": F.round("spread", 9), "area_ratio": F.round("area_ratio", 6)})


@query(f""", r AS (SELECT *, {_PX} AS px, {_PY} AS py FROM di), x AS (SELECT plan_id, room_id, CASE WHEN tax < 8 THEN 2 ELSE 1 END AS axes, CASE WHEN tax < 8 THEN (ln(px) + ln(py)) / 2 ELSE ln(py) END AS implied, 1 - disc * 0.06 AS c, ppf FROM r)
SELECT plan_id, arg_min(room_id, (-axes, round(abs(implied - ln(ppf)), 9), -c, room_id)) AS room_id FROM x GROUP BY plan_id""", items=True)
def representative_room(spark: SparkSession, d: str) -> DataFrame:
    r = measured(V.distinct_items(spark, d)).select("plan_id", "room_id", "px", "py", (F.col("tax") < 8).alias("use_x"), F.lit(True).alias("use_y"), "confidence")
    plans = r.select("plan_id").distinct().select("plan_id", (F.lit(10) + F.col("plan_id") % 11).cast("double").alias("ppf"))
    return consensus.representative(r, plans)


_LINE = "room_id, w_ft * ppf AS len, CASE WHEN part % 3 = 0 THEN 'x' WHEN part % 3 = 1 THEN 'y' ELSE 'd' END AS ax, w_ft * (1 + disc / 100.0) AS feet"


@query(f""", l AS (SELECT plan_id, {_LINE} FROM di), g AS (SELECT plan_id, max(room_id) FILTER (WHERE ax = 'd') AS d, max(room_id) FILTER (WHERE ax = 'x') AS x, max(room_id) FILTER (WHERE ax = 'y') AS y FROM l GROUP BY plan_id),
h AS (SELECT plan_id, CASE WHEN x > coalesce(d, -1) THEN x END AS x, CASE WHEN y > coalesce(d, -1) THEN y END AS y, d FROM g),
j AS (SELECT h.plan_id, h.x, h.y, CASE WHEN h.x IS NULL AND h.y IS NULL THEN h.d END AS d FROM h),
k AS (SELECT j.*, a.feet / a.len AS sx, b.feet / b.len AS sy, c.feet / (c.len * sqrt(2)) AS sd, a.len AS lx, b.len AS ly, c.len * sqrt(2) AS ld FROM j LEFT JOIN l a ON a.plan_id = j.plan_id AND a.room_id = j.x LEFT JOIN l b ON b.plan_id = j.plan_id AND b.room_id = j.y LEFT JOIN l c ON c.plan_id = j.plan_id AND c.room_id = j.d)
SELECT plan_id, round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN abs(ln(sx / sy)) <= 0.05 THEN sqrt(sx * sy) ELSE sx END ELSE coalesce(sd, sx, sy) END, 9) AS sx,
  round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN abs(ln(sx / sy)) <= 0.05 THEN sqrt(sx * sy) ELSE sy END ELSE coalesce(sd, sx, sy) END, 9) AS sy,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 'x,y' WHEN d IS NOT NULL THEN 'diagonal' WHEN x IS NOT NULL THEN 'x' ELSE 'y' END AS axes,
  round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(lx, ly) ELSE coalesce(ld, lx, ly) END, 6) AS length_px, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS line_count FROM k""", items=True)
def line_scale(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("w_ft") * F.col("ppf"), F.col("part") % 3
    end = F.struct((F.lit(5.0) + F.when(k == 1, 0.0).otherwise(n)).alias("x"), (F.lit(7.0) + F.when(k == 0, 0.0).otherwise(n)).alias("y"))
    lines = V.distinct_items(spark, d).select("plan_id", F.col("room_id").alias("ord"), F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y")).alias("start"), end.alias("end"), (F.col("w_ft") * (1 + F.col("disc") / 100.0)).alias("feet"))
    out = consensus.line_scale(lines)
    return out.select("plan_id", F.round("x", 9).alias("sx"), F.round("y", 9).alias("sy"), "axes", F.round("length_px", 6).alias("length_px"), "line_count")


@query(f""", s AS (SELECT plan_id, unnest([{_PX}, {_PY}]) / ppf / ppf AS v FROM it), o AS (SELECT plan_id, list_sort(list(v)) AS a FROM s GROUP BY plan_id),
m AS (SELECT *, a[len(a) // 2 + 1] AS med, len(a) AS n, a[-1] / a[1] AS spread FROM o), k AS (SELECT *, list_filter(a, lambda v: abs(ln(v / med)) <= 0.25) AS kept FROM m), p AS (SELECT *, kept[len(kept) // 2 + 1] AS plan FROM k),
r AS (SELECT i.*, p.plan, p.n, p.spread, {_BOX.replace('w_ft *', 'i.w_ft *')} FROM it i JOIN p USING (plan_id)), q AS (SELECT *, abs(ln(dw / dh) - ln(bw / bh)) > 0.05 AND abs(ln(dw / dh) + ln(bw / bh)) < abs(ln(dw / dh) - ln(bw / bh)) AS sw FROM r),
t AS (SELECT *, CASE WHEN sw THEN dh ELSE dw END / bw AS x, CASE WHEN sw THEN dw ELSE dh END / bh AS y FROM q),
u AS (SELECT *, abs(ln(x / y)) AS iso, CASE WHEN abs(ln(x / y)) <= 0.05 THEN x WHEN n >= 4 AND spread <= 2 THEN plan ELSE sqrt(x * y) END AS room FROM t),
z AS (SELECT *, n >= 2 AND abs(ln(room / plan)) > 0.22 AS apart, n >= 2 AND abs(ln(room / plan)) > 0.22 AND n >= 4 AND spread <= 2 AS held FROM u)
SELECT plan_id, line, part, NOT held AS adopted, CASE WHEN apart THEN 'check' WHEN iso <= 0.05 THEN 'ok' WHEN iso > 0.25 THEN 'check' ELSE 'note' END AS level, CASE WHEN apart THEN 'room-vs-project' WHEN iso > 0.05 THEN 'room-internal' END AS reason,
  round(CASE WHEN held THEN plan ELSE room END, 9) AS sx, (n // 2)::BIGINT AS room_count FROM z""", items=True)
def room_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = measured(V.items(spark, d)).withColumns({"fx": F.col("px") / F.col("ppf") / F.col("ppf"), "fy": F.col("py") / F.col("ppf") / F.col("ppf")})
    plans = rows.groupBy("plan_id").agg(F.flatten(F.collect_list(F.array("fx", "fy"))).alias("others")).select("plan_id", F.size("others").alias("n"), S.robust(F.col("others")).alias("plan"))  # once for each plan
    swap = F.col("part") % 3 == 0
    b = rows.join(plans, "plan_id").select(
        "plan_id", "line", "part", "n", "plan", (F.col("w_ft") * F.col("ppf") * (1 + F.col("disc") / 50.0)).alias("bw"), (F.col("h_ft") * F.col("ppf") * (1 + F.col("tax") / 100.0)).alias("bh"),
        F.when(swap, F.col("h_ft")).otherwise(F.col("w_ft")).alias("dw"), F.when(swap, F.col("w_ft")).otherwise(F.col("h_ft")).alias("dh"),
    )
    b = b.withColumn("r", S.decide_by(*[F.col(c) for c in ("dw", "dh", "bw", "bh")], F.col("n"), F.col("plan")))
    r = F.col("r")
    return b.select("plan_id", "line", "part", r["adopted"].alias("adopted"), r["level"].alias("level"), r["reason"].alias("reason"), F.round(r["x"], 9).alias("sx"), r["room_count"].alias("room_count"))


@query("""
WITH m AS (SELECT o_orderkey AS k, (o_orderkey % 5)::INTEGER AS missed, (o_orderkey % 7)::INTEGER AS total, o_orderkey % 2 = 0 AS drawn, ['manual', 'line', 'auto', NULL][o_orderkey % 4 + 1] AS source FROM orders)
SELECT k, round(CASE WHEN missed = 0 OR total = 0 THEN 1 WHEN drawn THEN greatest(0.85, 1 - 0.3 * (missed / total)) ELSE greatest(0.35, 1 - missed / total) END, 9)::DOUBLE AS factor, coalesce(source IN ('manual', 'line'), false) AS pinned FROM m""")
def constraint_factors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    source = F.element_at(F.array(*[F.lit(x).cast("string") for x in ("manual", "line", "auto", None)]), (k % 4 + 1).cast("int"))
    return V.read(spark, d, "orders").select(k.alias("k"), F.round(S.constraint_factor(k % 5, k % 7, k % 2 == 0), 9).alias("factor"), S.user_asserted(source).alias("pinned"))
