"""Queries on drawings: outlines found in rasters that are drawn from known shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import detect
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.sources import images

THICK = 5


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """A house for each supplier: a rectangle, or an L where the key is even."""
    k = F.col("s_suppkey")
    w, h = 160 + (k * 7) % 100, 120 + (k * 13) % 90
    w, h = (w - w % 2).cast("double"), (h - h % 2).cast("double")
    x0, y0 = F.lit(20.0), F.lit(20.0)
    from plumbline.functions.geom import point

    ell = F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h / 2), point(x0 + w / 2, y0 + h / 2), point(x0 + w / 2, y0 + h), point(x0, y0 + h))
    return V.spread(V.read(spark, d, "supplier").select("s_suppkey")).select(k.alias("plan_id"), F.when(k % 2 == 0, ell).otherwise(V.rectangle(x0, y0, x0 + w, y0 + h)).alias("ring"))


@query("""
WITH m AS (SELECT s_suppkey AS k, 160 + (s_suppkey * 7) % 100 AS w0, 120 + (s_suppkey * 13) % 90 AS h0 FROM supplier), n AS (SELECT k, (w0 - w0 % 2)::DOUBLE AS w, (h0 - h0 % 2)::DOUBLE AS h FROM m)
SELECT k AS plan_id, 0::BIGINT AS floor, CASE WHEN k % 2 = 0 THEN (w + 5) * (h + 5) - (w - floor(w / 2)) * (h - floor(h / 2)) ELSE (w + 5) * (h + 5) END AS area_px, CASE WHEN k % 2 = 0 THEN 6 ELSE 4 END AS corners FROM n""")
def traced_floors(spark: SparkSession, d: str) -> DataFrame:
    """Each house's outline, found again in its drawing: its outer faces stand half a wall outside the shape."""
    f = detect.floors(images.drawn(outlines(spark, d), 300, 260, THICK))
    return f.select("plan_id", "floor", F.round("area_px", 3).alias("area_px"), F.size("ring").alias("corners"))


def doors(spark: SparkSession, d: str) -> DataFrame:
    """Houses with an opening in the top wall: none, a door of 14, or one of 0.45 of the wall, and a smaller building far to the right or below it in every other drawing."""
    k = F.col("s_suppkey")
    w, h = 160 + (k * 7) % 100, 120 + (k * 13) % 90
    return V.spread(V.read(spark, d, "supplier").select("s_suppkey")).select(k.alias("plan_id"), w.cast("int").alias("w"), h.cast("int").alias("h"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 14).otherwise(F.floor(w * 0.45)).cast("int").alias("gap"), (k % 2).cast("int").alias("two"))


def _pages(house: DataFrame) -> DataFrame:
    import numpy as np
    import pandas as pd

    def draw(frames):
        for f in frames:
            for r in f.itertuples():
                box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
                page = images.drawing([box(20, 20, r.w, r.h), *([box(r.w + 110, 40, 100, 80)] if r.two else [])], 500, 260, THICK)
                if r.gap:
                    a = 20 + (r.w - r.gap) // 2
                    page[15:26, a : a + r.gap, :3] = 255
                yield pd.DataFrame({"plan_id": [r.plan_id], "width": [500], "height": [260], "data": [page.tobytes()]})

    return house.mapInPandas(draw, "plan_id bigint, width int, height int, data binary")


_DOORS = "h AS (SELECT s_suppkey AS k, 160 + (s_suppkey * 7) % 100 AS w, 120 + (s_suppkey * 13) % 90 AS h FROM supplier)"


@query(f"""
WITH {_DOORS} SELECT k AS plan_id, 0::BIGINT AS floor, ((w + 5) * (h + 5))::DOUBLE AS area_px, CASE WHEN k % 3 = 2 THEN 'span' ELSE 'weld' END AS policy FROM h
UNION ALL SELECT k, 1, (105 * 85)::DOUBLE, 'weld' FROM h WHERE k % 2 = 1""")
def rescued_floors(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of houses with openings: a door is welded, a wide opening is closed by walls at full length, and a second building is the second floor in reading order."""
    f = detect.floors(_pages(doors(spark, d)))
    return f.select("plan_id", "floor", F.round("area_px", 3).alias("area_px"), F.when(F.col("policy") == "raw", "weld").otherwise(F.col("policy")).alias("policy"))


PPF = 8.0


@query("""
SELECT s_suppkey AS plan_id, CASE s_suppkey % 5 WHEN 4 THEN 16.0 ELSE 8.0 END::DOUBLE AS ppf, CASE WHEN s_suppkey % 5 IN (0, 2) THEN 'ok' ELSE 'check' END AS level,
  CASE s_suppkey % 5 WHEN 1 THEN 'too-few-rooms' WHEN 3 THEN 'area-implausible' WHEN 4 THEN 'area-implausible' ELSE 'auto-consensus' END AS reason, CASE s_suppkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 4 END::BIGINT AS room_count FROM supplier""")
def auto_scale(spark: SparkSession, d: str) -> DataFrame:
    """Each house divided in four rooms, whose printed lengths are those of their inner faces at 8 pixels a foot: the scale found is that again. By the key, a house has all
    four labels; two of them; a garage's label in its last room; a traced outline that is much too small; or half the lengths printed in two of its rooms."""
    import numpy as np
    import pandas as pd

    from plumbline.operators import rooms

    k = F.col("s_suppkey")
    w, h = 160 + (k * 7) % 100, 120 + (k * 13) % 90
    house = V.spread(V.read(spark, d, "supplier").select("s_suppkey")).select(k.alias("plan_id"), (w - w % 2).cast("int").alias("w"), (h - h % 2).cast("int").alias("h"))

    def draw(frames):
        for f in frames:
            for r in f.itertuples():
                x, y, x1, y1 = 20, 20, 20 + r.w, 20 + r.h
                mx, my = x + r.w // 2, y + r.h // 2
                page = images.drawing([np.array([(x, y), (x1, y), (x1, y1), (x, y1)]), np.array([(mx, y), (mx, y1)]), np.array([(x, my), (x1, my)])], 300, 260, THICK)
                yield pd.DataFrame({"plan_id": [r.plan_id], "width": [300], "height": [260], "data": [page.tobytes()]})

    pages = house.mapInPandas(draw, "plan_id bigint, width int, height int, data binary")
    left, top = F.floor(F.col("w") / 2), F.floor(F.col("h") / 2)
    side = lambda name, x, y, dw, dh: F.struct(F.lit(name).cast("bigint").alias("label_id"), F.lit(f"Room {name}").alias("name"), x.cast("double").alias("x"), y.cast("double").alias("y"), ((dw - THICK) / PPF).alias("dim_w"), ((dh - THICK) / PPF).alias("dim_h"))
    right, low = F.col("w") - left, F.col("h") - top
    four = F.array(
        side(0, 20 + left / 2, 20 + top / 2, left, top), side(1, 20 + left + right / 2, 20 + top / 2, right, top), side(2, 20 + left / 2, 20 + top + low / 2, left, low), side(3, 20 + left + right / 2, 20 + top + low / 2, right, low)
    )
    case = F.col("plan_id") % 5
    half = F.when((case == 4) & (F.col("label_id") >= 2), 0.5).otherwise(1.0)
    marks = house.select("plan_id", F.explode(four).alias("m")).select("plan_id", "m.*").filter((case != 1) | (F.col("label_id") < 2))
    marks = marks.withColumns({"dim_w": F.col("dim_w") * half, "dim_h": F.col("dim_h") * half})
    feet = house.select("plan_id", (F.col("w") * F.col("h") * F.when(case == 3, 0.25).otherwise(1.0)).cast("double").alias("area_px"))
    garage = house.filter(case == 2).select("plan_id", (F.col("w") + 5).cast("double").alias("x"), (F.col("h") + 5).cast("double").alias("y"))
    return rooms.auto_scale(pages, marks, feet, garage).select("plan_id", F.round("ppf", 6).alias("ppf"), "level", "reason", "room_count")
