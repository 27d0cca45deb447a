"""Queries on printed dimensions. The expected lengths are computed from the numbers, never by reading the text again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import dimtext as T
from plumbline.functions import units
from plumbline.plans import views as V
from plumbline.plans.registry import query

#: Feet a and b are the printed numbers' parts: 2 to 31 feet, and inches below 12.
_PARTS = "(2 + line * 3 + part % 8)::BIGINT AS a, (4 + h_ft % 20)::BIGINT AS b, (w_ft % 12)::BIGINT AS i, (part % 12)::BIGINT AS j, part % 12 AS k"


def printed(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("part")
    one = V.items(spark, d).select("plan_id", "line", "part", (F.lit(2) + F.col("line") * 3 + p % 8).alias("a"), (F.lit(4) + F.col("h_ft").cast("bigint") % 20).alias("b"), (F.col("w_ft").cast("bigint") % 12).alias("i"), (p % 12).alias("j"), (p % 12).alias("k"))
    s = lambda f: F.format_string(f, "a", "i", "b", "j")
    forms = [
        s("%d'%d\" x %d'%d\""), s("%d' %d” × %d’ %d″"), s("%d ft %d in X %d ft %d in"), s("%d'-%d\" by %d'-%d\""), F.format_string("%d.5 x %d.5", "a", "b"), F.format_string("%d.5 ft x %d.5 ft", "a", "b"),
        F.format_string("%d.25 m x %d.5 m", F.floor(F.col("a") / 3) + 1, F.floor(F.col("b") / 3) + 1), F.format_string("%d x %d", "a", "b"), s("BEDROOM %d'%d\" x %d'%d\""), s("%d'%d\"  %d'%d\""), s("%d-%d x %d-%d"), F.format_string("%d ft %d ft", "a", "b"),
    ]
    return one.withColumn("text", F.element_at(F.array(*forms), (F.col("k") + 1).cast("int")))


@query(f""", m AS (SELECT plan_id, line, part, {_PARTS} FROM it), f AS (SELECT *, CASE WHEN k IN (0, 1, 2, 3, 8, 9, 10) THEN a + i / 12 WHEN k IN (4, 5) THEN a + 0.5 WHEN k = 6 THEN (a // 3 + 1.25) * 3.28084 ELSE a END AS w, CASE WHEN k IN (0, 1, 2, 3, 8, 9, 10) THEN b + j / 12 WHEN k IN (4, 5) THEN b + 0.5 WHEN k = 6 THEN (b // 3 + 1.5) * 3.28084 ELSE b END AS h FROM m)
SELECT plan_id, line, part, round(w, 9)::DOUBLE AS width, round(h, 9)::DOUBLE AS height, CASE WHEN k IN (0, 1, 2, 3, 8, 9, 10) THEN 'inches' WHEN k = 6 THEN 'meters' ELSE 'decimal' END AS format FROM f""", items=True)
def parsed_dimensions(spark: SparkSession, d: str) -> DataFrame:
    p = printed(spark, d).withColumn("pair", T.parse_lines("text"))
    return p.select("plan_id", "line", "part", F.round("pair.width", 9).alias("width"), F.round("pair.height", 9).alias("height"), F.col("pair.format").alias("format"))


@query(f""", m AS (SELECT plan_id, line, part, {_PARTS} FROM it), c AS (SELECT plan_id, count(*) FILTER (WHERE k IN (0, 1, 2, 3, 8, 9, 10)) AS n, count(*) FILTER (WHERE k IN (4, 5, 7, 11)) AS e, count(*) FILTER (WHERE k = 6) AS m FROM m GROUP BY plan_id)
SELECT plan_id, CASE WHEN n >= e AND n >= m THEN 'inches' WHEN e >= m THEN 'decimal' ELSE 'meters' END AS format FROM c""", items=True)
def dominant_format(spark: SparkSession, d: str) -> DataFrame:
    p = printed(spark, d).select("plan_id", T.parse_lines("text")["format"].alias("f"))
    return p.groupBy("plan_id").agg(T.dominant(F.col("f")).alias("format"))


@query(f""", m AS (SELECT plan_id, line, part, {_PARTS} FROM it)
SELECT plan_id, line, part, CASE k % 3 WHEN 0 THEN a || ''' ' || i || '" x ' || b || ''' ' || j || '"' WHEN 1 THEN a || '.5 m x ' || b || ' m' ELSE a || '.25 x ' || b END AS text FROM m""", items=True)
def written_dimensions(spark: SparkSession, d: str) -> DataFrame:
    p = printed(spark, d)
    k = F.col("k") % 3
    fmt = F.when(k == 0, "inches").when(k == 1, "meters").otherwise("decimal")
    m = T.FEET_PER_METER
    w = F.when(k == 0, F.col("a") + F.col("i") / 12).when(k == 1, (F.col("a") + 0.5) * m).otherwise(F.col("a") + 0.25)
    h = F.when(k == 0, F.col("b") + F.col("j") / 12).when(k == 1, F.col("b") * m).otherwise(F.col("b").cast("double"))
    return p.select("plan_id", "line", "part", T.written(w, h, fmt).alias("text"))


@query(""", m AS (SELECT plan_id, part, line, part % 4 AS k, CASE WHEN part % 4 < 2 THEN 'explicit' WHEN part % 4 = 2 THEN 'tick-space' ELSE 'tick' END AS style FROM it), c AS (SELECT plan_id, style, count(*) AS n, max(line * 100000 + part) AS last FROM m GROUP BY ALL)
SELECT plan_id, arg_max(style, (n, last)) AS style FROM c GROUP BY plan_id""", items=True)
def unit_styles(spark: SparkSession, d: str) -> DataFrame:
    """The style most of a plan's dimensions are written in; of equal ones that of the latest dimension."""
    k = F.col("part") % 4
    text = F.when(k == 0, "12 ft 3 in").when(k == 1, "9 in").when(k == 2, "12' 3\"").otherwise("12'3\"")
    one = V.items(spark, d).select("plan_id", units.style_of(text, F.lit("inches")).alias("style"), (F.col("line") * 100000 + F.col("part")).alias("at"))
    n = one.groupBy("plan_id", "style").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return n.groupBy("plan_id").agg(F.max_by("style", F.struct("n", "last")).alias("style"))


@query("""
WITH m AS (SELECT o_orderkey AS k, (o_orderkey % 110)::DOUBLE AS c, o_orderkey % 3 = 0 AS neural, o_orderkey % 2 = 0 AS targeted, [0, 7, 13][o_orderkey % 3 + 1] AS penalty FROM orders)
SELECT k, greatest(0, least(100, floor(CASE WHEN neural THEN 76 ELSE least(97, c) END + CASE WHEN targeted AND penalty = 0 THEN 6 ELSE 0 END - penalty + 0.5)))::INTEGER AS confidence FROM m""")
def reading_confidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pair = F.struct(F.element_at(F.array(F.lit(0), F.lit(7), F.lit(13)), (k % 3 + 1).cast("int")).alias("penalty"))
    return V.read(spark, d, "orders").select(k.alias("k"), T.confidence(pair, (k % 110).cast("double"), k % 3 == 0, k % 2 == 0).alias("confidence"))
