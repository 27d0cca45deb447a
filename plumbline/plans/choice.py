"""Queries on scores, choice among candidates, ladders and capped lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import ranking as R
from plumbline.plans import views as V
from plumbline.plans.registry import query

_CAND = """, c AS (SELECT plan_id, room_id, 1 - disc / 20.0 AS seal, 1 - tax / 16.0 AS support, (50 + part % 51) / 100.0 AS coverage, (line * 3)::DOUBLE AS radius, 20.0 AS max_radius, w_ft * 4 AS bridged_span, 10000.0 AS wall_area, 9000 + h_ft * 60 AS bbox_area,
  CASE WHEN part % 5 = 0 THEN NULL ELSE 0.75 + (part % 26) / 100.0 END AS completeness, CASE WHEN part % 2 = 0 THEN (part % 11) / 10.0 END AS fit, CASE WHEN part % 7 = 0 THEN (part % 9) / 8.0 END AS brush_fit, CASE WHEN flag = 'R' THEN 'structural' ELSE 'all' END AS variant, flag AS policy, w_ft * 3 AS longest_gap, 200 + h_ft AS perimeter FROM di),
e AS (SELECT *, 1 - least(greatest(0.6 * least(greatest(radius / greatest(2, max_radius), 0), 1) + 0.4 * least(greatest(bridged_span / greatest(40, 0.35 * sqrt(wall_area)), 0), 1), 0), 1) AS economy, least(greatest(greatest(0, bbox_area / wall_area - 1.02) / 0.3, 0), 1) AS annex,
  least(greatest((0.97 - coalesce(completeness, 1)) / 0.2, 0), 1) AS thin, CASE WHEN fit IS NULL THEN 0 WHEN brush_fit IS NULL THEN 0.22 ELSE 0.08 END AS fw, CASE WHEN brush_fit IS NULL THEN 0 ELSE 0.25 END AS bw FROM c),
s AS (SELECT *, (0.34 * seal + 0.30 * support + 0.26 * coverage + 0.10 * economy + fw * coalesce(fit, 0) + bw * coalesce(brush_fit, 0)) / (1 + fw + bw) - 0.3 * annex - 0.3 * thin AS score FROM e)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("part")
    return V.distinct_items(spark, d).select(
        "plan_id", "room_id", (1 - F.col("disc") / 20.0).alias("seal"), (1 - F.col("tax") / 16.0).alias("support"), ((F.lit(50) + p % 51) / 100.0).alias("coverage"), (F.col("line") * 3).cast("double").alias("radius"), F.lit(20.0).alias("max_radius"),
        (F.col("w_ft") * 4).alias("bridged_span"), F.lit(10000.0).alias("wall_area"), (F.lit(9000) + F.col("h_ft") * 60).alias("bbox_area"), F.when(p % 5 != 0, F.lit(0.75) + (p % 26) / 100.0).alias("completeness"), F.when(p % 2 == 0, (p % 11) / 10.0).alias("fit"),
        F.when(p % 7 == 0, (p % 9) / 8.0).alias("brush_fit"), F.when(F.col("flag") == "R", "structural").otherwise("all").alias("variant"), F.col("flag").alias("policy"), (F.col("w_ft") * 3).alias("longest_gap"), (F.lit(200) + F.col("h_ft")).alias("perimeter"),
    )


@query(_CAND + """, f AS (SELECT *, brush_fit IS NOT NULL AS drawn FROM s), g AS (SELECT *, seal < 0.55 AS r1, support < CASE WHEN drawn THEN 0.4 ELSE 0.6 END AS r2, longest_gap > greatest(24, 0.08 * perimeter) AS r3, radius >= 12 AS r4, annex > 0.15 AS r5, coalesce(completeness, 1) < 0.9 AS r6, coverage < 0.9 AS r7, coalesce(brush_fit < 0.75, false) AS r8 FROM f)
SELECT plan_id, room_id, round(score, 12) AS score, round(economy, 12) AS economy, round(annex, 12) AS annex,
  round(1.7e-11 + greatest(0.05, least(0.98, seal * (0.3 + 0.7 * support) * CASE WHEN r1 THEN 0.35 ELSE 1 END * CASE WHEN r2 THEN 0.75 ELSE 1 END * CASE WHEN r3 THEN 1 - least(0.35, longest_gap / (0.5 * perimeter)) ELSE 1 END * CASE WHEN r4 THEN 0.85 ELSE 1 END * CASE WHEN r5 THEN 1 - 0.4 * annex ELSE 1 END
    * CASE WHEN r6 THEN 0.7 ELSE 1 END * CASE WHEN r7 THEN 0.6 + 0.4 * coverage ELSE 1 END * CASE WHEN r8 THEN 0.4 + 0.6 * brush_fit ELSE 1 END * CASE WHEN fit IS NULL THEN 1 WHEN drawn THEN 0.85 + 0.15 * fit ELSE 0.55 + 0.45 * fit END)), 9) AS confidence,
  array_to_string(list_filter([CASE WHEN r1 THEN 'unsealed' END, CASE WHEN r2 THEN 'weak-wall-support' END, CASE WHEN r3 THEN 'bridged-opening' END, CASE WHEN r4 THEN 'heavy-closing' END, CASE WHEN r5 THEN 'annexation' END, CASE WHEN r6 THEN 'incomplete-enclosure' END, CASE WHEN r7 THEN 'wall-left-outside' END, CASE WHEN r8 THEN 'brush-mismatch' END], lambda x: x IS NOT NULL), ',') AS codes FROM g""", items=True)
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    c = R.confidence(R.score(candidates(spark, d)).withColumn("drawn", F.col("brush_fit").isNotNull()))
    return c.select("plan_id", "room_id", *[F.round(x, 12).alias(x) for x in ("score", "economy", "annex")], F.round(F.col("confidence") + 1.7e-11, 9).alias("confidence"), F.array_join("codes", ",").alias("codes"))


_PICK = """, r9 AS (SELECT plan_id, room_id, round(score, 6) AS score, radius, bridged_span, variant, policy || room_id AS policy FROM s),
i AS (SELECT *, max(score) OVER (PARTITION BY plan_id) - score <= 0.015 AS near FROM r9), w AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY near DESC, variant = 'structural', radius, bridged_span, score DESC, variant, policy) = 1 AS won FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY won DESC, score DESC, radius, bridged_span, variant, policy) AS place FROM w)"""


@query(_CAND + _PICK + " SELECT plan_id, room_id, place FROM p", items=True)
def picked_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = R.score(candidates(spark, d)).withColumn("score", F.round("score", 6)).withColumn("policy", F.concat("policy", F.col("room_id").cast("string")))
    return R.pick(c, ["plan_id"]).select("plan_id", "room_id", "place")


@query(_CAND + _PICK + " SELECT plan_id, room_id, place FROM p WHERE place BETWEEN 2 AND 4", items=True)
def runner_up_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.alternatives(picked_candidates(spark, d))


_RUNG = ", g AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY room_id) AS radius, w_ft * h_ft AS area, 1 + disc % 3 AS parts FROM di), l AS (SELECT *, lag(area) OVER w AS pa, lag(parts) OVER w AS pp FROM g WINDOW w AS (PARTITION BY plan_id ORDER BY radius)), f AS (SELECT *, coalesce(area > pa * 1.03 AND parts < pp, false) AS fuses FROM l), k AS (SELECT plan_id, min(radius) AS cut FROM f WHERE fuses GROUP BY plan_id), r AS (SELECT f.plan_id, max(area) AS reference FROM f LEFT JOIN k USING (plan_id) WHERE radius < coalesce(cut, 1000000) GROUP BY ALL)"


@query(_RUNG + " SELECT f.plan_id, f.radius, f.area, r.reference, least(1, f.area / r.reference)::DOUBLE AS completeness FROM f JOIN r USING (plan_id) WHERE pa IS NULL OR abs(area - pa) > 0.005 * pa", items=True)
def closing_ladder(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("plan_id").orderBy("room_id")).cast("bigint")
    rungs = V.distinct_items(spark, d).select("plan_id", n.alias("radius"), (F.col("w_ft") * F.col("h_ft")).alias("area"), (1 + F.col("disc") % 3).alias("parts"))
    return R.climb(rungs, ["plan_id"]).drop("parts")


@query("""
WITH r AS (SELECT user_id AS plan_id, event_id AS roi_id, floor(value)::BIGINT % 10 AS priority, event_id % 3 = 0 AS vertical FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY plan_id, priority < 7, vertical ORDER BY priority DESC, roi_id) AS n FROM r),
k AS (SELECT * FROM n WHERE priority >= 7 OR n <= CASE WHEN vertical THEN 6 ELSE 12 END), a AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY priority DESC, roi_id) AS m FROM k) SELECT plan_id, roi_id, priority, vertical FROM a WHERE m <= 40""")
def reading_queue(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("roi_id"), (F.floor("value") % 10).alias("priority"), (F.col("event_id") % 3 == 0).alias("vertical"))
    return R.capped_regions(e)
