"""Scores, confidences and choice among candidate footprints; ladders of closing radii; ranked lists with limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAD = 0.015  # fixed value: how far below the leader a cheaper candidate may be


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def seal(cover: Column, solidity: Column) -> Column:
    return F.sqrt(clamp01(cover) * clamp01(solidity))


def score(c: DataFrame) -> DataFrame:
    """c with economy, annex and score. Columns: seal, support, coverage, radius, max_radius, bridged_span, wall_area, bbox_area, completeness, fit (null without constraints), brush_fit (null without a brush)."""
    economy = 1 - clamp01(0.6 * clamp01(F.col("radius") / F.greatest(F.lit(2.0), F.col("max_radius"))) + 0.4 * clamp01(F.col("bridged_span") / F.greatest(F.lit(40.0), 0.35 * F.sqrt("wall_area"))))
    annex = clamp01(F.greatest(F.lit(0.0), F.col("bbox_area") / F.greatest(F.lit(1.0), F.col("wall_area")) - 1.02) / 0.3)
    thin = clamp01((0.97 - F.coalesce("completeness", F.lit(1.0))) / 0.2)
    one = c.withColumns({"economy": economy, "annex": annex, "_thin": thin})
    fit_weight = F.when(F.col("fit").isNull(), 0.0).when(F.col("brush_fit").isNull(), 0.22).otherwise(0.08)
    brush_weight = F.when(F.col("brush_fit").isNull(), 0.0).otherwise(0.25)
    total = 0.34 * F.col("seal") + 0.30 * F.col("support") + 0.26 * F.col("coverage") + 0.10 * F.col("economy") + fit_weight * F.coalesce("fit", F.lit(0.0)) + brush_weight * F.coalesce("brush_fit", F.lit(0.0))
    return one.withColumn("score", total / (1.0 + fit_weight + brush_weight) - 0.3 * F.col("annex") - 0.3 * F.col("_thin")).drop("_thin")


def confidence(c: DataFrame) -> DataFrame:
    """c with confidence and codes, the warnings that lower it, in order. More columns: longest_gap, perimeter, drawn (whether a brush was used)."""
    rules = [
        ("unsealed", F.col("seal") < 0.55, F.lit(0.35)),
        ("weak-wall-support", F.col("support") < F.when(F.col("drawn"), 0.4).otherwise(0.6), F.lit(0.75)),
        ("bridged-opening", F.col("longest_gap") > F.greatest(F.lit(24.0), 0.08 * F.greatest(F.lit(1.0), F.col("perimeter"))), 1 - F.least(F.lit(0.35), F.col("longest_gap") / (0.5 * F.greatest(F.lit(1.0), F.col("perimeter"))))),
        ("heavy-closing", F.col("radius") >= 0.6 * F.col("max_radius"), F.lit(0.85)),
        ("annexation", F.col("annex") > 0.15, 1 - 0.4 * F.col("annex")),
        ("incomplete-enclosure", F.coalesce("completeness", F.lit(1.0)) < 0.9, F.lit(0.7)),
        ("wall-left-outside", F.col("coverage") < 0.9, 0.6 + 0.4 * F.col("coverage")),
        ("brush-mismatch", F.coalesce(F.col("brush_fit") < 0.75, F.lit(False)), 0.4 + 0.6 * F.coalesce("brush_fit", F.lit(1.0))),
    ]
    out = F.col("seal") * (0.3 + 0.7 * F.col("support"))
    for _, when, factor in rules:
        out = out * F.when(when, factor).otherwise(F.lit(1.0))
    out = out * F.when(F.col("fit").isNull(), F.lit(1.0)).when(F.col("drawn"), 0.85 + 0.15 * F.col("fit")).otherwise(0.55 + 0.45 * F.col("fit"))
    codes = F.array_compact(F.array(*[F.when(when, F.lit(code)) for code, when, _ in rules]))
    return c.withColumns({"confidence": F.greatest(F.lit(0.05), F.least(F.lit(0.98), out)), "codes": codes})


def pick(c: DataFrame, by: list[str]) -> DataFrame:
    """c with place, 1 for the winner of each group: within LEAD of the best score the cheapest (no invention, small radius, short span), then all by score.

    Columns: score, radius, bridged_span, variant, policy. The order is total, so it doesn't depend on that of the rows.
    """
    whole = W.partitionBy(*by)
    dear = (F.col("variant") == "structural").cast("int")
    one = c.withColumn("_in", F.max("score").over(whole) - F.col("score") <= LEAD)
    cheap = F.row_number().over(whole.orderBy(F.desc("_in"), dear, "radius", "bridged_span", F.desc("score"), "variant", "policy"))
    one = one.withColumn("_won", cheap == 1)
    place = F.row_number().over(whole.orderBy(F.desc("_won"), F.desc("score"), "radius", "bridged_span", "variant", "policy"))
    return one.withColumn("place", place.cast("bigint")).drop("_in", "_won")


def alternatives(placed: DataFrame) -> DataFrame:
    """The runners-up: places 2 to 4."""
    return placed.filter(F.col("place").between(2, 4))


def ladder_reference(rungs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., reference): the largest area among the rungs before the first that fuses parts (over 3 % more area from fewer parts).

    rungs: radius, area, parts.
    """
    order = W.partitionBy(*by).orderBy("radius")
    fuses = (F.col("area") > F.lag("area").over(order) * 1.03) & (F.col("parts") < F.lag("parts").over(order))
    cut = rungs.withColumn("_f", F.coalesce(fuses, F.lit(False)).cast("int")).withColumn("_cut", F.max("_f").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return cut.filter("_cut = 0").groupBy(*by).agg(F.max("area").alias("reference"))


def climb(rungs: DataFrame, by: list[str], step: float = 0.005) -> DataFrame:
    """The rungs that change the area by more than a step against the rung before, with completeness against the reference."""
    before = F.lag("area").over(W.partitionBy(*by).orderBy("radius"))
    kept = rungs.withColumn("_b", before).filter(F.col("_b").isNull() | (F.abs(F.col("area") - F.col("_b")) > step * F.col("_b"))).drop("_b")
    return kept.join(ladder_reference(rungs, by), by).withColumn("completeness", F.least(F.lit(1.0), F.col("area") / F.col("reference")))


def capped_regions(rois: DataFrame, sure: int = 7, across: int = 12, down: int = 6, most: int = 40) -> DataFrame:
    """The regions to read of each plan: all of priority sure or more, the best of the guesses across and down, and no more than most. rois: plan_id, roi_id, priority, vertical."""
    best = W.partitionBy("plan_id", "_guess", "vertical").orderBy(F.desc("priority"), "roi_id")
    one = rois.withColumn("_guess", F.col("priority") < sure).withColumn("_n", F.row_number().over(best))
    kept = one.filter(~F.col("_guess") | (F.col("_n") <= F.when(F.col("vertical"), down).otherwise(across)))
    return kept.withColumn("_all", F.row_number().over(W.partitionBy("plan_id").orderBy(F.desc("priority"), "roi_id"))).filter(F.col("_all") <= most).drop("_guess", "_n", "_all")
