"""Queries on rasters as run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import raster as R
from plumbline.plans import views as V
from plumbline.plans.registry import query

#: The raster of events: users down, hours across; several plans by the month's thirds.
WIDTH, HEIGHT = 240, 150
_CELLS = f"""
WITH e AS (SELECT user_id AS y, floor((epoch(ts) - 1704067200) / 3600)::BIGINT AS h, value FROM events), c AS (SELECT h // {WIDTH} + 1000 * (y // {HEIGHT}) AS plan_id, y % {HEIGHT} AS y, h % {WIDTH} AS x, count(*) AS n, least(255, floor(max(value)))::BIGINT AS gray FROM e GROUP BY ALL)"""
_GRID = f", g AS (SELECT p.plan_id, y.y, x.x, c.plan_id IS NOT NULL AS ink FROM (SELECT DISTINCT plan_id FROM c) p, range(-4, {HEIGHT + 4}) y(y), range(-4, {WIDTH + 4}) x(x) LEFT JOIN c ON c.plan_id = p.plan_id AND c.y = y.y AND c.x = x.x)"
_RUNS = "SELECT plan_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY plan_id, y ORDER BY x) AS k FROM {0}) GROUP BY plan_id, y, k"
PLAN = ["plan_id"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    return V.cells(spark, d).select((F.floor(F.col("x") / WIDTH) + 1000 * F.floor(F.col("y") / HEIGHT)).alias("plan_id"), (F.col("y") % HEIGHT).alias("y"), (F.col("x") % WIDTH).alias("x"), "n", "gray")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return R.islands(cells(spark, d).select("plan_id", "y", "x"), ["plan_id", "y"], "x")


def _long(df: DataFrame) -> DataFrame:
    return df.select("plan_id", "y", F.col("x0").cast("bigint").alias("x0"), F.col("x1").cast("bigint").alias("x1"))


def _square(kind: str, inside: str = "g", r: int = 1) -> str:
    f = {"dilate": "bool_or", "erode": "bool_and"}[kind]
    frame = f"ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING"
    return f"(SELECT plan_id, y, x, {f}(ink) OVER (PARTITION BY plan_id, x ORDER BY y {frame}) AS ink FROM (SELECT plan_id, y, x, {f}(ink) OVER (PARTITION BY plan_id, y ORDER BY x {frame}) AS ink FROM {inside}))"


_CUT = f"(SELECT * FROM {{0}} WHERE ink AND x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1})"


@query(_CELLS + " " + _RUNS.format("c"))
def ink_runs(spark: SparkSession, d: str) -> DataFrame:
    return _long(runs(spark, d))


@query(_CELLS + _GRID + " " + _RUNS.format(_CUT.format(_square("dilate"))))
def dilated(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.dilate(runs(spark, d), PLAN, 1, WIDTH, HEIGHT))


@query(_CELLS + _GRID + ", t AS (SELECT plan_id, y, x, bool_or(ink) OVER (PARTITION BY plan_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ink FROM g), u AS (SELECT * FROM t WHERE ink AND x BETWEEN 0 AND 239 AND y BETWEEN 0 AND 149), v AS (SELECT g.plan_id, g.y, g.x, u.plan_id IS NOT NULL AS ink FROM g LEFT JOIN u USING (plan_id, y, x)) " + _RUNS.format(_CUT.format(_square("erode", "v"))))
def eroded(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.erode(R.dilate_rows(runs(spark, d), PLAN, 2, WIDTH), PLAN, 1))


@query(_CELLS + _GRID + " " + _RUNS.format(_CUT.format(_square("erode", _square("dilate")))))
def closed(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.closed(runs(spark, d), PLAN, 1, WIDTH, HEIGHT))


@query(_CELLS + _GRID + ", t AS (SELECT plan_id, y, x, ink AND x BETWEEN 0 AND 239 AND y BETWEEN 0 AND 149 AS ink FROM " + _square("dilate") + ") " + _RUNS.format(_CUT.format(_square("dilate", _square("erode", "t")))))
def opened(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.opened(R.dilate(runs(spark, d), PLAN, 1, WIDTH, HEIGHT), PLAN, 1, WIDTH, HEIGHT))


@query(_CELLS + """, k AS (SELECT plan_id, y, x, 'h' AS dir, y AS l, x AS a FROM c UNION ALL SELECT plan_id, y, x, 'v', x, y FROM c UNION ALL SELECT plan_id, y, x, 'd', x - y, x FROM c UNION ALL SELECT plan_id, y, x, 'a', x + y, x FROM c),
r AS (SELECT *, a - row_number() OVER (PARTITION BY plan_id, dir, l ORDER BY a) AS k FROM k), n AS (SELECT *, count(*) OVER (PARTITION BY plan_id, dir, l, k) AS n FROM r) SELECT DISTINCT plan_id, y, x FROM n WHERE n >= 3""")
def long_runs(spark: SparkSession, d: str) -> DataFrame:
    ink = runs(spark, d)
    parts = [R.long_runs(ink, PLAN, 3, k) for k in "hvda"]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct().select("plan_id", "y", F.col("x").cast("bigint").alias("x"))


@query(_CELLS + f", r AS ({_RUNS.format('c')}), q AS (SELECT *, lag(x1) OVER (PARTITION BY plan_id, y ORDER BY x0) AS p FROM r WHERE x1 - x0 + 1 >= 1), s AS (SELECT plan_id, y, unnest(range(p + 1, x0)) AS x FROM q WHERE x0 - p - 1 BETWEEN 1 AND 3),"
       " w AS (SELECT plan_id, x, y, lag(y) OVER (PARTITION BY plan_id, x ORDER BY y) AS p FROM c), z AS (SELECT plan_id, unnest(range(p + 1, y)) AS y, x FROM w WHERE y - p - 1 BETWEEN 1 AND 3), u AS (SELECT plan_id, y, x FROM c UNION SELECT plan_id, y, x FROM s UNION SELECT plan_id, y, x FROM z) " + _RUNS.format("u"))
def bridged(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.bridged(runs(spark, d), PLAN, 3, 1))


@query(_CELLS + f", r AS ({_RUNS.format('c')}), a AS (SELECT plan_id, x1 - x0 + 1 AS n FROM r UNION ALL SELECT plan_id, count(*) FROM (SELECT *, y - row_number() OVER (PARTITION BY plan_id, x ORDER BY y) AS k FROM c) GROUP BY plan_id, x, k), m AS (SELECT plan_id, n, sum(n) AS mass FROM a WHERE n <= 7 GROUP BY ALL)"
       " SELECT b.plan_id, b.min_x, b.min_y, b.max_x, b.max_y, b.ink, t.thickness FROM (SELECT plan_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS ink FROM c GROUP BY plan_id) b JOIN (SELECT plan_id, arg_max(n, (mass, -n)) AS thickness FROM m GROUP BY plan_id) t USING (plan_id)")
def ink_summary(spark: SparkSession, d: str) -> DataFrame:
    ink = _long(runs(spark, d))
    b, t = R.ink_bounds(ink, PLAN), R.stroke_thickness(ink, PLAN, 7)
    return b.join(t, "plan_id").select("plan_id", *[F.col(c).cast("bigint").alias(c) for c in ("min_x", "min_y", "max_x", "max_y", "ink", "thickness")])


@query(_CELLS + """, h AS (SELECT plan_id, gray AS level, count(*) AS n FROM c GROUP BY ALL), u AS (SELECT *, sum(n) OVER w AS nb, sum(n * level) OVER w AS sb, sum(n) OVER p AS total, sum(n * level) OVER p AS sa FROM h WINDOW w AS (PARTITION BY plan_id ORDER BY level), p AS (PARTITION BY plan_id)),
v AS (SELECT *, CASE WHEN total > nb THEN nb::DOUBLE * (total - nb) * (sb / nb - (sa - sb) / (total - nb)) * (sb / nb - (sa - sb) / (total - nb)) ELSE -1 END AS v FROM u) SELECT plan_id, arg_max(level, (v, -level)) AS threshold, max(total)::BIGINT AS total FROM v GROUP BY plan_id""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return R.otsu(R.histogram(cells(spark, d), PLAN), PLAN)


@query(_CELLS + ", g AS (SELECT p.plan_id, y.y, x.x, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT plan_id FROM c) p, range(0, 150) y(y), range(0, 240) x(x) LEFT JOIN c ON c.plan_id = p.plan_id AND c.y = y.y AND c.x = x.x), r AS (SELECT *, sum(n) OVER (PARTITION BY plan_id, y ORDER BY x) AS s FROM g) SELECT plan_id, y, x, sum(s) OVER (PARTITION BY plan_id, x ORDER BY y)::BIGINT AS sat FROM r")
def summed_area(spark: SparkSession, d: str) -> DataFrame:
    have = cells(spark, d)
    grid = have.select("plan_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1)).cast("array<bigint>"))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1)).cast("array<bigint>")))
    dense = grid.join(have.select("plan_id", "y", "x", "n"), ["plan_id", "y", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return R.prefix_sums(dense, PLAN, "n").select("plan_id", "y", "x", "sat")


@query(_CELLS + ", s AS (SELECT plan_id, y, x FROM c WHERE (y + x) % 5 < 3), r AS (SELECT plan_id, y, x FROM c EXCEPT SELECT plan_id, y, x FROM s) " + _RUNS.format("r"))
def ink_difference(spark: SparkSession, d: str) -> DataFrame:
    all_, some = runs(spark, d), R.islands(cells(spark, d).filter("(y + x) % 5 < 3").select("plan_id", "y", "x"), ["plan_id", "y"], "x")
    return _long(R.difference(all_, some, PLAN))


_COMPONENTS = _CELLS.replace("WITH", "WITH RECURSIVE", 1) + """, q AS (SELECT plan_id, y, x, y * 1048576 + x AS id FROM c), ed AS (SELECT a.plan_id, a.id AS u, b.id AS v FROM q a JOIN q b ON a.plan_id = b.plan_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
w AS (SELECT plan_id, id, id AS root FROM q UNION SELECT ed.plan_id, ed.v, w.root FROM w JOIN ed ON ed.plan_id = w.plan_id AND ed.u = w.id WHERE w.root < ed.v), m AS (SELECT plan_id, id, min(root) AS root FROM w GROUP BY ALL)
SELECT plan_id, root, count(*) AS size FROM m GROUP BY ALL"""


@query(_COMPONENTS)
def ink_components(spark: SparkSession, d: str) -> DataFrame:
    """(plan_id, root, size) of the 4-connected components."""
    from plumbline.sources.tables import Workspace

    out = R.components(runs(spark, d), PLAN, Workspace(spark, "components"))
    return out.groupBy("plan_id", "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("size"))


@query(_CELLS + """, t AS (SELECT *, n % 3 AS r FROM c), b AS (SELECT *, CASE WHEN 2 * sum((gray < 12)::INTEGER) OVER (PARTITION BY plan_id) > count(*) OVER (PARTITION BY plan_id) THEN 1 - (gray < 12)::INTEGER ELSE (gray < 12)::INTEGER END AS ink FROM t)
SELECT plan_id, y // 3 AS y, x // 3 AS x, max(ink) AS ink, floor(avg(gray) + 0.5)::BIGINT AS gray FROM b GROUP BY ALL""")
def pooled_pixels(spark: SparkSession, d: str) -> DataFrame:
    c = R.binarized(cells(spark, d).drop("n"), PLAN, F.lit(12))
    return R.pooled(c, PLAN, 3)


@query(_CELLS + """, h AS (SELECT plan_id, gray, count(*) AS n FROM c GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY plan_id ORDER BY gray) AS k, sum(n) OVER (PARTITION BY plan_id) AS t FROM h),
l AS (SELECT plan_id, min(gray) FILTER (WHERE k >= 0.05 * t) AS a, min(gray) FILTER (WHERE k >= 0.95 * t) AS b FROM u GROUP BY plan_id)
SELECT plan_id, y, x, greatest(0, least(255, floor((gray - a) * 255 / (b - a))))::BIGINT AS gray FROM c JOIN l USING (plan_id)""")
def stretched_pixels(spark: SparkSession, d: str) -> DataFrame:
    return R.stretched(cells(spark, d).drop("n"), PLAN, 0.05, 0.95).select("plan_id", "y", "x", "gray")


@query(_CELLS + ", k AS (SELECT plan_id, x - 20 AS y, 79 - (y - 10) AS x FROM c WHERE y BETWEEN 10 AND 89 AND x BETWEEN 20 AND 139) " + _RUNS.format("k"))
def turned_crop(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.turned(R.cropped(runs(spark, d), PLAN, 20, 10, 139, 89), PLAN, 120, 80))


@query(_CELLS + " SELECT plan_id, coalesce(round(avg((NOT EXISTS (SELECT 1 FROM c b WHERE b.plan_id = c.plan_id AND abs(b.x - c.x) + abs(b.y - c.y) = 1))::INTEGER) FILTER (WHERE x % 2 = 1 AND y % 2 = 1 AND x < 239 AND y < 149), 9), 0) AS speckle FROM c GROUP BY plan_id")
def speckle(spark: SparkSession, d: str) -> DataFrame:
    return R.speckle(cells(spark, d), PLAN, WIDTH, HEIGHT).withColumn("speckle", F.round("speckle", 9))
