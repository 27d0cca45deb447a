"""Areas by type, for plans and for all together; colours and names of outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geom, labels, units


def trace_areas(traces: DataFrame) -> DataFrame:
    """traces with normal_type and area (square feet), of those visible and with three corners. Columns: ring, holes, type, visible, fpp."""
    shown = traces.filter(F.col("visible") & (F.size("ring") >= 3))
    return shown.withColumns({"normal_type": labels.normal_type(F.col("type")), "area": geom.area_sqft(F.col("ring"), F.col("holes"), F.col("fpp"), F.col("fpp"))})


def area_by_type(traces: DataFrame) -> DataFrame:
    """(plan_id, type, area, n, grouping): by plan and type, by plan, by type, and in all; grouping is 0, 1, 2 or 3."""
    one = trace_areas(traces).select("plan_id", "normal_type", "area")
    part = one.groupBy("plan_id", "normal_type").agg(F.sum("area").alias("area"), F.count("*").alias("n"))
    cube = part.groupingSets([[F.col("plan_id"), F.col("normal_type")], [F.col("plan_id")], [F.col("normal_type")], []], F.col("plan_id"), F.col("normal_type"))
    return cube.agg(F.sum("area").alias("area"), F.sum("n").alias("n"), F.grouping_id().cast("bigint").alias("grouping")).select("plan_id", F.col("normal_type").alias("type"), "area", "n", "grouping")


def shown_totals(traces: DataFrame, unit: str) -> DataFrame:
    """(plan_id, shown, gla): the sum of each plan's rows as they are shown, not the sum rounded; and the living area as shown."""
    part = trace_areas(traces).groupBy("plan_id", "normal_type").agg(F.sum("area").alias("area"))
    shown = units.area_shown(F.round("area", 6), F.lit(unit))
    return part.groupBy("plan_id").agg(F.sum(shown).alias("shown"), F.coalesce(F.sum(F.when(F.col("normal_type") == "gla", shown)), F.lit(0.0)).alias("gla"))


def workspace(traces: DataFrame, live: DataFrame) -> DataFrame:
    """(from_disk, type, plans, area): the property's areas over plans that have some; a plan in live (plan_id) counts as measured now, others as remembered."""
    part = trace_areas(traces).groupBy("plan_id", "normal_type").agg(F.sum("area").alias("area"))
    total = W.partitionBy("plan_id")
    kept = part.withColumn("total", F.sum("area").over(total)).filter("total > 0").join(live.select("plan_id", F.lit(False).alias("disk")), "plan_id", "left")
    return kept.groupBy(F.coalesce("disk", F.lit(True)).alias("from_disk"), F.col("normal_type").alias("type")).agg(F.countDistinct("plan_id").alias("plans"), F.sum("area").alias("area"))


def colored(traces: DataFrame, order: str) -> DataFrame:
    """traces with nth and color: the nth outline of a type in its plan, from 0, has the nth shade; user colours stay (color_source, color)."""
    kind = labels.normal_type(F.col("type"))
    nth = F.row_number().over(W.partitionBy("plan_id", "_t").orderBy(order)) - 1
    one = traces.withColumn("_t", kind).withColumn("nth", nth)
    return one.withColumn("color", F.when(F.col("color_source") == "type", labels.shade(labels.type_color(F.col("type")), F.col("nth"))).otherwise(F.col("color"))).drop("_t")


def next_name(names: DataFrame, type_: str) -> DataFrame:
    """(plan_id, next_name) of one more outline of a type: a storey's number is above all storeys' and above the number of outlines; other nouns get
    the first free number. names: plan_id, name."""
    if type_ == "gla":
        n = F.greatest(F.coalesce(F.max(labels.storey_number(F.col("name"))), F.lit(0)), F.count("*")) + 1
        return names.groupBy("plan_id").agg(n.alias("n")).select("plan_id", F.concat(F.col("n").cast("string"), labels.ordinal_suffix(F.col("n")), F.lit(" Floor")).alias("next_name"))
    noun = labels.NOUNS[type_]
    taken = names.groupBy("plan_id").agg(F.collect_set("name").alias("taken"), F.count("*").alias("n"))
    wanted = F.transform(F.sequence(F.lit(1), F.col("n") + 2), lambda i: F.when(i == 1, F.lit(noun)).otherwise(F.concat(F.lit(noun + " "), i.cast("string"))))
    return taken.select("plan_id", F.get(F.array_except(wanted, F.col("taken")), F.lit(0)).alias("next_name"))
