"""Project files: JSON of one drawing with its outlines, scale and images; drafts with images apart.

Images are kept once under their key and named by it. Reading refuses newer versions and broken shapes, replaces what is no number by zero, and promotes a
scale of one number to one of both axes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1  # fixed value
POINT = "struct<x: double, y: double>"
TRACE = f"struct<id: string, name: string, type: string, visible: boolean, vertices: array<{POINT}>, holes: array<struct<id: string, ring: array<{POINT}>, source: string, stale: boolean>>, nameSource: string, typeSource: string, colorSource: string>"
SCHEMA = f"struct<metadata: struct<version: int, title: string, savedAt: string>, settings: struct<unit: string, scale: struct<x: double, y: double>, scalar: double>, imageRef: string, images: map<string, string>, traces: array<{TRACE}>>"


def finite(x: Column) -> Column:
    """x, or zero for what is no finite number."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def finite_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(finite(p["x"]).alias("x"), finite(p["y"]).alias("y")))


def file_name(title: Column, day: Column, ending: str = ".json") -> Column:
    """A name without what file systems refuse, and the day."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', " "), r"\s+", " "))
    return F.concat(F.when(clean == "", F.lit("Untitled")).otherwise(clean), F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit(ending))


def serialize(plans: DataFrame) -> DataFrame:
    """(plan_id, json). plans: plan_id, title, unit, sx, sy, image, image_key, traces (array of TRACE)."""
    traces = F.transform("traces", lambda t: t.withField("vertices", finite_ring(t["vertices"])))
    body = F.struct(
        F.struct(F.lit(VERSION).alias("version"), F.col("title").alias("title")).alias("metadata"),
        F.struct(F.col("unit").alias("unit"), F.struct(finite(F.col("sx")).alias("x"), finite(F.col("sy")).alias("y")).alias("scale")).alias("settings"),
        F.col("image_key").alias("imageRef"),
        F.when(F.col("image_key").isNotNull(), F.create_map("image_key", "image")).alias("images"),
        traces.alias("traces"),
    )
    return plans.select("plan_id", F.to_json(body).alias("json"))


def parse(files: DataFrame, column: str = "json") -> DataFrame:
    """files with p, the project, and image, which the project names. Raises on JSON that doesn't fit the schema or is of a newer version."""
    p = F.from_json(F.col(column), SCHEMA, {"mode": "FAILFAST"})
    one = files.withColumn("p", p)
    newer = F.coalesce(F.col("p.metadata.version"), F.lit(VERSION)) > VERSION
    checked = F.when(newer, F.raise_error(F.concat(F.lit("project version "), F.col("p.metadata.version").cast("string"), F.lit(" is newer than this reader")))).otherwise(F.col("p"))
    s = F.col("p.settings")
    both = F.coalesce(s["scale"], F.when(s["scalar"].isNotNull(), F.struct(s["scalar"].alias("x"), s["scalar"].alias("y"))))
    return one.withColumn("p", checked).withColumns({"scale": both, "image": F.try_element_at("p.images", F.col("p.imageRef"))})


def split_drafts(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with image_key instead of image, images by key): each image is written once."""
    key = F.when(F.col("image").isNotNull(), F.sha2("image", 256))
    keyed = drafts.withColumn("image_key", key)
    images = keyed.filter("image_key IS NOT NULL").groupBy("image_key").agg(F.any_value("image").alias("image"))
    return keyed.drop("image"), images


def join_drafts(records: DataFrame, images: DataFrame) -> DataFrame:
    """Records with their images and status: no-image where a record names one that is gone, ok, or empty for a record without any."""
    out = records.join(images, "image_key", "left")
    return out.withColumn("status", F.when(F.col("image_key").isNull(), "empty").when(F.col("image").isNull(), "no-image").otherwise("ok"))


def unreferenced(images: DataFrame, records: DataFrame) -> DataFrame:
    """The images that no record names."""
    return images.join(records.select("image_key").dropna().distinct(), "image_key", "left_anti")
