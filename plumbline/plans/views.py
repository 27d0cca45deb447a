"""Domain views over the star-schema tables: outlines, rooms, labels, rasters. Each is a projection, deterministic, and plain SQL in DuckDB too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geom import point


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if its files give fewer tasks than there are: a single small file is one task otherwise. Large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def hundredths(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("bigint")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line item: plan, line, part, the two printed lengths, small numbers from discount and tax, flag and type."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("h_ft"), F.col("p_type").alias("ptype"))
    line = spread(
        read(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("plan_id"),
            F.col("l_linenumber").cast("bigint").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_quantity").alias("w_ft"),
            hundredths(F.col("l_discount")).alias("disc"),
            hundredths(F.col("l_tax")).alias("tax"),
            F.col("l_returnflag").alias("flag"),
        )
    )
    return line.join(part, "part").withColumn("ppf", F.lit(10) + F.col("plan_id") % 11)


def distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items, one for each plan, line, part and length, with a room_id that orders a plan's rooms."""
    keys = ["plan_id", "line", "part", "w_ft"]
    one = items(spark, sf_dir).groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("h_ft", "ptype", "disc", "tax", "flag", "ppf")])
    return one.withColumn("room_id", F.col("line") * 100000000 + F.col("part") * 100 + F.col("w_ft").cast("bigint"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def as_traces(rows: DataFrame) -> DataFrame:
    """Outlines of items: a rectangle or an L of the printed lengths at the plan's pixels per foot, and perhaps a hole, stale or not."""
    w, h, x0, y0 = F.col("w_ft") * F.col("ppf"), F.col("h_ft") * F.col("ppf"), (F.col("line") * 100).cast("double"), (F.col("part") % 50).cast("double")
    ell = F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h / 2), point(x0 + w / 2, y0 + h / 2), point(x0 + w / 2, y0 + h), point(x0, y0 + h))
    hole = F.struct(F.lit("h").alias("id"), rectangle(x0 + w / 8, y0 + h / 8, x0 + w * 3 / 8, y0 + h * 3 / 8).alias("ring"), F.when(F.col("part") % 3 == 0, F.lit("user")).otherwise(F.lit("auto")).alias("source"), (F.col("tax") > 6).alias("stale"))
    known = {"STANDARD": "gla", "PROMO": "below-grade", "MEDIUM": "garage", "ECONOMY": "porch", "SMALL": "unfinished"}
    kind = F.col("ptype")
    for a, b in known.items():
        kind = F.when(F.col("ptype") == a, F.lit(b)).otherwise(kind)
    return rows.withColumns({
        "ring": F.when(F.col("part") % 2 == 0, ell).otherwise(rectangle(x0, y0, x0 + w, y0 + h)),
        "holes": F.when(F.col("disc") > 5, F.array(hole)).otherwise(F.array().cast("array<struct<id:string,ring:array<struct<x:double,y:double>>,source:string,stale:boolean>>")),
        "type": kind,
        "visible": F.col("flag") != "R",
        "fpp": 1 / F.col("ppf"),
    })


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_traces(items(spark, sf_dir))


LABELS = ["BASEMENT", "2nd  Floor", "GARAGE 20' x 9'", "DN TO BSMT", "Total 1250 sq ft", "Main Level", "Sun Deck", "Lower lvl", "KITCHEN", "Swimming  Pool", "floor 3", "Stairs", "COVERED PORCH", "garden level"]


def label_text(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (n % len(LABELS) + 1).cast("int"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster in long form: a row for each (y, x) of ink, x the hour since 2024 began, y the user; gray from the values."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("y"), F.floor((F.unix_timestamp("ts") - 1704067200) / 3600).cast("bigint").alias("x"), "value")
    return e.groupBy("y", "x").agg(F.count("*").alias("n"), F.least(F.lit(255), F.floor(F.max("value"))).cast("bigint").alias("gray"))
