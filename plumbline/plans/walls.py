"""Queries on walls: houses in run tables, whose segments, openings, depths and networks are known from how they are drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import cavities, floods, glazing, retrace, ruling, strokes, walls
from plumbline.operators import raster as R
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.sources.tables import Workspace

PLAN = ["plan_id"]
THICK, DOOR, STUB = 5, 12, 20
#: A house's walls have their middles on the box (20, 20) to (20 + w, 20 + h); the right one has a door, with walls beside it outside where the key is a multiple of 3.
_H = "h AS (SELECT s_suppkey AS k, 160 + (s_suppkey * 7) % 100 AS w, 120 + (s_suppkey * 13) % 90 AS h, 50 + s_suppkey % 20 AS dy FROM supplier)"


def houses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return V.read(spark, d, "supplier").select(k.alias("plan_id"), (F.lit(160) + k * 7 % 100).alias("w"), (F.lit(120) + k * 13 % 90).alias("h"), (F.lit(50) + k % 20).alias("dy"))


def runs_of(house: DataFrame) -> DataFrame:
    """plan_id, net, y, x0, x1: the left, top and bottom walls are network 0, the right one, above and below its door, is 1 and 2, its stubs 1 and 2 too."""
    bar = lambda net, x0, y0, x1, y1: F.struct(F.lit(net).cast("bigint").alias("net"), x0.cast("bigint").alias("x0"), y0.cast("bigint").alias("y0"), x1.cast("bigint").alias("x1"), y1.cast("bigint").alias("y1"))
    a, z = F.lit(18), F.lit(22)  # a wall of 5 about 20
    r, b, door = F.lit(20) + F.col("w"), F.lit(20) + F.col("h"), F.lit(20) + F.col("dy")
    walls_ = [bar(0, a, a, z, b + 2), bar(0, z + 1, a, r + 2, z), bar(0, z + 1, b - 2, r + 2, b + 2), bar(1, r - 2, z + 1, r + 2, door - 1), bar(2, r - 2, door + DOOR, r + 2, b - 3)]
    stubs = [bar(1, r + 3, door - THICK, r + 2 + STUB, door - 1), bar(2, r + 3, door + DOOR, r + 2 + STUB, door + DOOR - 1 + THICK)]
    each = F.when(F.col("plan_id") % 3 == 0, F.array(*walls_, *stubs)).otherwise(F.array(*walls_))
    row = house.select("plan_id", F.explode(each).alias("b")).select("plan_id", "b.net", "b.x0", "b.x1", F.explode(F.sequence("b.y0", "b.y1")).alias("y"))
    return row.select("plan_id", "net", "y", "x0", "x1")


def _ink(spark: SparkSession, d: str) -> DataFrame:
    return R.merged(runs_of(houses(spark, d)), [*PLAN, "y"])


def _segments(spark: SparkSession, d: str) -> DataFrame:
    ink, work = _ink(spark, d), Workspace(spark, "segments")
    return work.save(walls.segments(ink, PLAN, work, "h", 40, 8, 20, 2.0).unionByName(walls.segments(ink, PLAN, work, "v", 12, 8, 20, 2.0)), "walls")


@query(f"""
WITH {_H}
SELECT k AS plan_id, 'h' AS dir, unnest([20, 20 + h])::DOUBLE AS center, 18::BIGINT AS lo, 22 + w AS hi, 5 + w AS drawn, 5::BIGINT AS thickness, 1::BIGINT AS parts FROM h
UNION ALL SELECT k, 'v', 20::DOUBLE, 18, 22 + h, 5 + h, 5, 1 FROM h UNION ALL SELECT k, 'v', (20 + w)::DOUBLE, 18, 22 + h, 5 + h - 12, 5, 2 FROM h""")
def wall_segments(spark: SparkSession, d: str) -> DataFrame:
    """Straight walls along both axes; the two halves of the one with a door are one."""
    return _segments(spark, d)


@query(f"WITH {_H} SELECT k AS plan_id, 12::BIGINT AS total, 12::DOUBLE AS longest, ((w + 5) * 10 + (h - 5) * 10)::BIGINT AS painted FROM h")
def bridged_spans(spark: SparkSession, d: str) -> DataFrame:
    """What is open in a house's walls, and the ink of its walls with openings closed."""
    s = _segments(spark, d)
    full = R.ink_bounds(walls.painted(s, PLAN), PLAN).select("plan_id", F.col("ink").cast("bigint").alias("painted"))
    return walls.bridged_span(s, PLAN).join(full, "plan_id")


@query(f"WITH {_H} SELECT k AS plan_id, 5::BIGINT AS bridges, CASE WHEN k % 3 = 0 THEN 0 ELSE 5 END::BIGINT AS guarded FROM h")
def guarded_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a door that are bridged: all where the wall goes straight on, none where walls go off at both sides of it."""
    down = R.transposed(_ink(spark, d), PLAN)
    plain = R.bridges(down, PLAN, 16, 20).groupBy("plan_id").agg(F.count("*").alias("bridges"))
    kept = walls.guarded_bridges(down, PLAN, 16, 20, 25).groupBy("plan_id").agg(F.count("*").alias("guarded"))
    return plain.join(kept, "plan_id", "left").select("plan_id", "bridges", F.coalesce("guarded", F.lit(0)).cast("bigint").alias("guarded"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """A point in the house, one in the door's row, and one outside of it."""
    h = houses(spark, d)
    at = lambda n, x, y: F.struct(F.lit(n).cast("bigint").alias("point_id"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    mid = (F.lit(20) + F.floor(F.col("w") / 2)).alias("x")
    each = F.array(at(0, mid, F.lit(30)), at(1, mid, F.lit(20) + F.col("dy") + 5), at(2, F.col("w") + 60, F.lit(40)))
    return h.select("plan_id", F.explode(each).alias("p")).select("plan_id", "p.*")


def _nets(spark: SparkSession, d: str) -> DataFrame:
    row = runs_of(houses(spark, d))
    box = row.groupBy("plan_id", "net").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return box.withColumn("seals", (F.col("plan_id") % 4 == 0) & (F.col("net") != 1))


@query(f"WITH {_H} SELECT k AS plan_id, unnest([0, 0, 0, 1, 1, 1])::BIGINT AS point_id, unnest([0, 1, 2, 0, 1, 2])::BIGINT AS net FROM h")
def implicated_networks(spark: SparkSession, d: str) -> DataFrame:
    """Networks around points: a ray to the right goes through the door, so its point has three hits and reaches past both halves of the wall; a point outside has too few."""
    return walls.implicated(_points(spark, d), _ink(spark, d), _nets(spark, d), 400)


def _bar(net: int | None, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A wall, both ends inside."""
    return F.struct(F.lit(net).cast("bigint").alias("net"), *[c.cast("bigint").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def _drawn(house: DataFrame, bars: Column) -> DataFrame:
    return house.select("plan_id", F.explode(bars).alias("b")).select("plan_id", "b.net", "b.x0", "b.x1", F.explode(F.sequence("b.y0", "b.y1")).alias("y")).select("plan_id", "net", "y", "x0", "x1")


def _ring(net: int, x0: Column, y0: Column, x1: Column, y1: Column, door: Column | None = None) -> list[Column]:
    """The four walls of THICK pixels of a house with that outer box; its right wall has a door of DOOR pixels from a row on, if told."""
    t = THICK - 1
    right = [(y0, y1)] if door is None else [(y0, door - 1), (door + DOOR, y1)]
    return [_bar(net, x0, y0, x0 + t, y1), _bar(net, x0, y0, x1, y0 + t), _bar(net, x0, y1 - t, x1, y1), *[_bar(net, x1 - t, a, x1, b) for a, b in right]]


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Each house as two angles that nearly meet (networks 0 and 1); where the key is a multiple of 4 as a closed ring in a closed ring."""
    h = houses(spark, d)
    lo, r, b = F.lit(18), F.col("w") + 22, F.col("h") + 22
    angles = F.array(_bar(0, lo, lo, F.lit(22), b), _bar(0, F.lit(23), lo, r - 20, F.lit(22)), _bar(1, r - 4, lo, r, b), _bar(1, F.lit(38), b - 4, r - 5, b))
    rings = F.array(*_ring(0, lo, lo, r, b), *_ring(1, lo + 30, lo + 30, r - 30, b - 30))
    ink = _drawn(h, F.when(F.col("plan_id") % 4 == 0, rings).otherwise(angles))
    return R.merged(ink, ["plan_id", "net", "y"])


_SEALED = f"WITH {_H}, n AS (SELECT *, unnest([0, 1])::BIGINT AS net FROM h)"


@query(_SEALED + " SELECT k AS plan_id, net, CASE WHEN k % 4 = 0 THEN (w + 5 - 60 * net) * (h + 5 - 60 * net) WHEN net = 0 THEN 5 * (h + 5) + 5 * (w - 20) ELSE 5 * (h + 5) + 5 * (w - 20) END::BIGINT AS area, k % 4 = 0 AS seals FROM n")
def sealed_networks(spark: SparkSession, d: str) -> DataFrame:
    """What each network encloses once its openings are closed, and whether that fills its own extent: rings do, angles don't."""
    work = Workspace(spark, "seals")
    return floods.self_seals(_pieces(spark, d), ["plan_id", "net"], THICK, work).select("plan_id", "net", F.col("area").cast("bigint").alias("area"), "seals")


@query(f"WITH {_H} SELECT k AS plan_id, 0::BIGINT AS root, '0,1' AS nets, (10 * (w + h) - 150)::BIGINT AS ink FROM h WHERE k % 4 <> 0")
def joined_networks(spark: SparkSession, d: str) -> DataFrame:
    """Networks that are traced as one, with their ink; where two of them close by themselves, which is computed, they aren't joined."""
    work = Workspace(spark, "joins")
    ink = work.save(_pieces(spark, d), "pieces")
    seals = floods.self_seals(ink, ["plan_id", "net"], THICK, work).select("plan_id", "net", "seals")
    box = floods.boxes(ink, ["plan_id", "net"]).select("plan_id", "net", F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))
    at = houses(spark, d).select("plan_id", F.lit(0).cast("bigint").alias("point_id"), F.lit(36).cast("bigint").alias("x"), (F.lit(20) + F.floor(F.col("h") / 2)).alias("y"))
    around = walls.implicated(at, R.merged(ink.select("plan_id", "y", "x0", "x1"), ["plan_id", "y"]), box, 400)
    groups = work.save(walls.joins(around, work.save(box.join(R.large(seals), ["plan_id", "net"]), "nets"), work), "groups")
    one = walls.joined(ink, groups).groupBy("plan_id", "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("ink"))
    return groups.select("plan_id", "root", F.array_join(F.transform("nets", lambda n: n.cast("string")), ",").alias("nets")).join(R.large(one), ["plan_id", "root"])


#: Plans that need tracing again or don't, by their account's balance a: 0 a whole house; 1 two angles that nearly meet; 2 two whole houses, and a mark between them under a loose line; 3 a house with a corner open.
_P = "p AS (SELECT s_suppkey AS k, floor(abs(s_acctbal))::BIGINT AS a FROM supplier), q AS (SELECT k, a % 4 AS kind, 160 + a % 97 AS w, 120 + a // 7 % 89 AS h FROM p)"


def _doubtful(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nets, points, rooms)."""
    a = F.floor(F.abs("s_acctbal")).cast("bigint")
    h = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("plan_id"), (a % 4).alias("kind"), (F.lit(160) + a % 97).alias("w"), (F.lit(120) + F.floor(a / 7) % 89).alias("h"), (F.lit(60) + a % 20).alias("door"))
    lo, r, b, aside = F.lit(18), F.col("w") + 22, F.col("h") + 22, F.col("w") + 65
    angles = F.array(_bar(0, lo, lo, F.lit(22), b), _bar(0, F.lit(23), lo, r - 20, F.lit(22)), _bar(1, r - 4, lo, r, b), _bar(1, F.lit(38), b - 4, r - 5, b))
    whole = F.array(*_ring(0, lo, lo, r, b, F.col("door")))
    two = F.array(*_ring(0, lo, lo, r, b, F.col("door")), *_ring(1, lo + aside, lo, r + aside, b), _bar(None, r + 10, lo, r + 50, F.lit(22)))
    corner = F.array(_bar(0, lo, lo, F.lit(22), b), _bar(0, lo, lo, r, F.lit(22)), _bar(0, lo, b - 4, r, b), _bar(0, r - 4, lo, r, b - 50))
    ink = R.merged(_drawn(h, F.when(F.col("kind") == 0, whole).when(F.col("kind") == 1, angles).when(F.col("kind") == 2, two).otherwise(corner)), ["plan_id", "net", "y"])
    mid = F.struct(F.lit(0).cast("bigint").alias("point_id"), (F.lit(20) + F.floor(F.col("w") / 2)).alias("x"), (F.lit(20) + F.floor(F.col("h") / 2)).alias("y"))
    mark = F.struct(F.lit(1).cast("bigint").alias("point_id"), (r + 30).alias("x"), (F.lit(20) + F.floor(F.col("h") / 2)).alias("y"))
    points = h.select("plan_id", F.explode(F.when(F.col("kind") == 2, F.array(mid, mark)).otherwise(F.array(mid))).alias("p")).select("plan_id", "p.*")
    at = lambda x: x.cast("bigint")
    rooms = h.select("plan_id", F.lit(9).cast("bigint").alias("rect_id"), at(F.lit(30)).alias("x0"), at(F.lit(30)).alias("y0"), at(F.col("w") + 10).alias("x1"), at(F.col("h") + 10).alias("y1"))
    return ink, points, rooms


@query(f"""
WITH {_P}
SELECT k AS plan_id, CASE kind WHEN 1 THEN 'join' WHEN 3 THEN 'escalate' ELSE 'base' END AS how, CASE kind WHEN 0 THEN 0 ELSE 1 END::INTEGER AS tried, CASE WHEN kind IN (0, 2) THEN 2 ELSE 0 END::BIGINT AS before,
  2::BIGINT AS held, CASE kind WHEN 2 THEN 3 ELSE 2 END::BIGINT AS total, ((w + 5) * (h + 5) * CASE kind WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS area FROM q""")
def retraced_plans(spark: SparkSession, d: str) -> DataFrame:
    """Plans traced again where known places are left out: what was taken in the end, how many attempts that took, the places held before and after, and the area of the outlines that stand."""
    ink, points, rooms = _doubtful(spark, d)
    state, _, prints = retrace.retrace(ink, points, rooms, THICK, 500, Workspace(spark, "retrace"))
    area = prints.groupBy("plan_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("area"))
    return state.join(area, "plan_id").select("plan_id", "how", F.col("tried").cast("int").alias("tried"), "before", "held", "total", "area")


@query(f"""
WITH {_P} SELECT k AS plan_id, 58::BIGINT AS x0, 18::BIGINT AS y0, 81 + a % 17 AS x1, 22::BIGINT AS y1, 5 * (24 + a % 17) AS size FROM p WHERE a % 3 = 0
UNION ALL SELECT k, 18, 70, 22, 89 + a % 11, 5 * (20 + a % 11) FROM p WHERE a % 2 = 0""")
def glazed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows drawn as grey bands in the top wall, where they have its faces (else they are off by 4 pixels, or too short), and in the left one; grey furniture in the room is none."""
    a = F.floor(F.abs("s_acctbal")).cast("bigint")
    h = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("plan_id"), a.alias("a"), (F.lit(160) + a % 97).alias("w"), (F.lit(120) + F.floor(a / 7) % 89).alias("h"))
    r, b, n, m = F.col("w") + 22, F.col("h") + 22, F.lit(24) + F.col("a") % 17, F.lit(20) + F.col("a") % 11
    top = F.when(F.col("a") % 3 == 2, F.lit(8)).otherwise(n)
    side = F.col("a") % 2 == 0
    lo = F.lit(18)
    bars = F.array(_bar(0, lo, lo, F.lit(57), F.lit(22)), _bar(0, F.lit(58) + top, lo, r, F.lit(22)), _bar(0, lo, b - 4, r, b), _bar(0, r - 4, lo, r, b), _bar(0, lo, lo, F.lit(22), F.when(side, F.lit(69)).otherwise(b)), _bar(0, lo, F.when(side, F.lit(70) + m).otherwise(lo), F.lit(22), b))
    wall = R.merged(_drawn(h, bars).select("plan_id", "y", "x0", "x1"), ["plan_id", "y"])
    shift = F.when(F.col("a") % 3 == 1, F.lit(4)).otherwise(F.lit(0))
    band = lambda x0, y0, x1, y1: _bar(0, x0, y0, x1, y1)
    grey = F.array_compact(F.array(band(F.lit(58), lo - shift, F.lit(57) + top, F.lit(22) - shift), band(F.lit(60), F.lit(60), F.lit(99), F.lit(64)), band(F.lit(110), F.lit(60), F.lit(139), F.lit(89)), F.when(side, band(lo, F.lit(70), F.lit(22), F.lit(69) + m))))
    paint = R.pixels(_drawn(h, grey), ["plan_id", "y"]).withColumn("gray", (F.lit(150) + (F.col("x") + F.col("y")) % 30).cast("bigint"))
    page = h.select("plan_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("y"), F.col("w")).select("plan_id", F.col("y").cast("bigint").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") + 400)).alias("x")).withColumn("gray", (F.lit(228) + F.col("x") % 5).cast("bigint"))
    work = Workspace(spark, "glazing")
    cells = work.save(paint.unionByName(page).withColumn("ink", F.lit(False)), "cells")
    found = glazing.windows(glazing.screened(cells, PLAN), work.save(wall, "wall"), PLAN, THICK, work)
    return found.select("plan_id", *[F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1", "size")])


@query(f"""
WITH {_P}, n AS (SELECT k, 3 + a % 9 AS dashes, a % 4 AS rows FROM p)
SELECT k AS plan_id, count(*)::BIGINT AS lines, (sum(CASE WHEN dashes >= 5 THEN dashes * 24 ELSE 0 END) + sum(CASE WHEN r = 0 THEN 200 ELSE 0 END))::BIGINT AS ink FROM n, range(0, 4) t(r) WHERE r <= rows GROUP BY k""")
def ruled_lines(spark: SparkSession, d: str) -> DataFrame:
    """The ink of ruling lines of drawings that have rows of 3 to 11 dashes (of which 5 make a line), a leader of 100 pixels, and words: tall letters with hyphens between them, which stay."""
    a = F.floor(F.abs("s_acctbal")).cast("bigint")
    h = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("plan_id"), (F.lit(3) + a % 9).alias("dashes"), (a % 4).alias("rows"))
    at = lambda x0, y0, x1, y1: _bar(0, x0, y0, x1, y1)
    line = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rows")), lambda r: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("dashes") - 1), lambda k: at(F.lit(10) + k * 20, F.lit(40) + r * 30, F.lit(21) + k * 20, F.lit(41) + r * 30)))
    leader = F.array(at(F.lit(300), F.lit(20), F.lit(399), F.lit(21)))
    word = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.array(at(F.lit(300) + k * 16, F.lit(200), F.lit(305) + k * 16, F.lit(215)), at(F.lit(308) + k * 16, F.lit(207), F.lit(313) + k * 16, F.lit(208)))))
    word = F.slice(word, F.lit(1), F.size(word) - 1)
    ink = R.merged(_drawn(h, F.concat(F.flatten(line), leader, word)).select("plan_id", "y", "x0", "x1"), ["plan_id", "y"])
    found = ruling.ruling_lines(ink, PLAN, Workspace(spark, "ruling")).groupBy("plan_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("ink"))
    return h.join(found, "plan_id", "left").select("plan_id", (F.col("rows") + 1).alias("lines"), F.coalesce("ink", F.lit(0).cast("bigint")).alias("ink"))


@query("""
WITH l AS (SELECT p_partkey AS k, 80 + floor(p_retailprice)::BIGINT % 61 AS w, 60 + p_size::BIGINT AS h, CASE WHEN p_size % 8 = 7 THEN 45 ELSE p_size::BIGINT % 12 END AS g, p_size::BIGINT % 5 AS e FROM part),
m AS (SELECT *, g < 45 AS shut, (w + 13) * (h + 13) AS loop, (w - 13) * (h - 13) AS core, (w + 1 + 3 * e) * (h + 1) AS outline FROM l)
SELECT k AS plan_id, 1::BIGINT AS nets, (2 * (w + 1) + 2 * (h - 1) - CASE WHEN shut THEN 0 ELSE g - 13 END)::BIGINT AS wall_size, CASE WHEN shut THEN loop ELSE loop - core - 13 * (g - 13) END::BIGINT AS area,
  CASE WHEN shut THEN round(1 - greatest(0, 3 * e - 6) * (h + 1) / outline::DOUBLE, 9) END AS fit FROM m""")
def stroke_regions(spark: SparkSession, d: str) -> DataFrame:
    """Loops drawn with a brush of radius 6 around houses whose walls lie under its middle: their networks, the wall under them, the region they enclose where a gap in the loop is left, closed by four
    pixels, and how well the house's outline, too wide by 0 to 12 pixels, fits it; a loop that is too far open encloses nothing but itself."""
    p = F.col("p_size").cast("bigint")
    h = V.read(spark, d, "part").select(F.col("p_partkey").alias("plan_id"), (F.lit(80) + F.floor("p_retailprice") % 61).alias("w"), (F.lit(60) + p).alias("h"), F.when(p % 8 == 7, F.lit(45)).otherwise(p % 12).alias("g"), (p % 5).alias("e"))
    lo, at = F.lit(40), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    r, b = lo + F.col("w"), lo + F.col("h")
    # the gap is in the left side, below its middle; the brush closes 13 pixels of it by itself
    start = lo + 20
    loop = F.array(at(lo, start), at(lo, lo), at(r, lo), at(r, b), at(lo, b), at(lo, start + F.col("g")))
    paint = strokes.painted(h.select("plan_id", loop.alias("points")), PLAN)
    work = Workspace(spark, "strokes")
    corridor = work.save(strokes.band(paint, PLAN, F.lit(6)), "corridor")
    wall = R.merged(_drawn(h, F.array(_bar(0, lo, lo, r, lo), _bar(0, lo, b, r, b), _bar(0, lo, lo, lo, b), _bar(0, r, lo, r, b))).select("plan_id", "y", "x0", "x1"), ["plan_id", "y"])
    nets, _ = strokes.networks(corridor, wall, PLAN, 6, work)
    inside = work.save(strokes.region(corridor, PLAN, F.lit(4), work), "inside")
    outline = _drawn(h, F.array(_bar(0, lo, lo, r + F.col("e") * 3, b))).select("plan_id", "y", "x0", "x1")
    area = inside.groupBy("plan_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("area"))
    n = nets.groupBy("plan_id").agg(F.count("*").alias("nets"), F.sum("wall_size").cast("bigint").alias("wall_size"))
    fit = strokes.fit(outline, inside, corridor, PLAN).select("plan_id", F.round("fit", 9).alias("fit"))
    return n.join(R.large(area), "plan_id").join(R.large(fit), "plan_id").join(R.large(h.select("plan_id", "g")), "plan_id").select("plan_id", "nets", "wall_size", "area", F.when(F.col("g") < 45, F.col("fit")).alias("fit"))


@query(f"""
WITH {_P} SELECT k AS plan_id, unnest([0, 1])::BIGINT AS label_id, unnest([22.5, 22.5 + w // 2])::DOUBLE AS x0, 22.5::DOUBLE AS y0, unnest([17.5 + w // 2, 17.5 + w])::DOUBLE AS x1, (17.5 + h)::DOUBLE AS y1 FROM q""")
def rooms_between_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two rooms that a wall parts which doesn't reach their labels' row: each is the largest that doesn't hold the other's label, by walls found in the drawing and the extent of its widest footprint."""
    a = F.floor(F.abs("s_acctbal")).cast("bigint")
    h = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("plan_id"), (F.lit(160) + a % 97).alias("w"), (F.lit(120) + F.floor(a / 7) % 89).alias("h"))
    lo, r, b, mid = F.lit(18), F.col("w") + 22, F.col("h") + 22, F.floor(F.col("w") / 2) + 20
    work = Workspace(spark, "rooms")
    ink = work.save(R.merged(_drawn(h, F.array(*_ring(0, lo, lo, r, b), _bar(0, mid - 2, lo, mid + 2, F.floor(F.col("h") / 2) + 20))).select("plan_id", "y", "x0", "x1"), ["plan_id", "y"]), "ink")
    found = work.save(walls.segments(ink, PLAN, work, "h", 40, 8, 20, 2.0).unionByName(walls.segments(ink, PLAN, work, "v", 12, 8, 20, 2.0)), "walls")
    limits = floods.boxes(floods.enclosed(ink, PLAN, work), PLAN)
    y = F.floor(F.col("h") * 3 / 4) + 20
    labels = h.select("plan_id", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("label_id"), (F.floor(F.col("w") * q / 4) + 20).alias("x"), y.alias("y")) for k, q in ((0, 1), (1, 3))])).alias("l")).select("plan_id", "l.*")
    return cavities.clamped_rooms(labels, found, limits, 60)


def _rings(spark: SparkSession, d: str, out: float) -> DataFrame:
    h = houses(spark, d)
    lo, r, b = F.lit(20.5 - out), F.col("w") + 20.5 + out, F.col("h") + 20.5 + out
    return h.select("plan_id", F.lit(0).alias("floor"), V.rectangle(lo, lo, r, b).alias("ring"))


@query(f"WITH {_H} SELECT k AS plan_id, 5::DOUBLE AS thickness, ((w - 5) * (h - 5))::DOUBLE AS inner_area, '5,5,5,5' AS insets FROM h")
def inner_faces(spark: SparkSession, d: str) -> DataFrame:
    """Depth of the walls behind the outer face, edge by edge, and the inner face that it leaves."""
    rings = _rings(spark, d, 2.5)
    deep = walls.depths(walls.samples(rings, 4.0, 8.0), _ink(spark, d), 12)
    whole = walls.thickness(deep, 3.0)
    edges = walls.insets(deep, whole)
    inner = walls.inner_faces(rings, edges, whole).select("plan_id", F.round(geom.ring_area(F.col("inner")), 6).alias("inner_area"))
    told = edges.groupBy("plan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("e", "inset"))), lambda s: s["inset"].cast("int").cast("string")), ",").alias("insets"))
    return whole.select("plan_id", "thickness").join(R.large(inner), "plan_id").join(R.large(told), "plan_id")


@query(f"WITH {_H} SELECT k AS plan_id, 2 * (w + h) AS samples, (2 * (w + h) - 10)::BIGINT AS held, 10::DOUBLE AS longest, 10::BIGINT AS n, (w + 20.5)::DOUBLE AS x0, (dy + 21.5)::DOUBLE AS y0, (dy + 30.5)::DOUBLE AS y1 FROM h")
def outline_support(spark: SparkSession, d: str) -> DataFrame:
    """How far an outline along the middle of the walls has ink within a pixel, and the longest stretch that has none: the door."""
    judged = walls.evidence(walls.samples(_rings(spark, d, 0.0), 1.0).filter("i < length"), _ink(spark, d), 1)
    n = judged.groupBy("plan_id").agg(F.count("*").alias("samples"), F.count_if("ink").alias("held"))
    s = walls.support(judged, 1.0).select("plan_id", "longest")
    return n.join(R.large(s), "plan_id").join(R.large(walls.bare_stretches(judged, 1.0).filter("x1 = x0").select("plan_id", "n", "x0", "y0", "y1")), "plan_id")


@query(f"""
WITH {_H}, a AS (SELECT k, (w + 5) * (h + 5) - (w - 5) * (h - 5) - 60 AS solid, CASE WHEN k % 3 = 0 THEN 200 ELSE 0 END AS stubs, 5 * (h + 5) + 10 * (40 - 22) AS kept FROM h)
SELECT k AS plan_id, round(kept / (solid + stubs * 0.25), 9)::DOUBLE AS coverage, kept::BIGINT AS shared FROM a""")
def ink_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of a house's ink left of a column; its stubs are thin and count a quarter."""
    h = houses(spark, d)
    ink = runs_of(h).withColumn("thin", F.col("x0") >= 0).join(R.large(h), "plan_id").withColumn("thin", F.col("x0") > F.col("w") + 22).select("plan_id", "y", "x0", "x1", "thin")
    mask = h.select("plan_id", F.explode(F.sequence(F.lit(0), F.col("h") + 40)).alias("y")).select("plan_id", F.col("y").cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("x0"), F.lit(40).cast("bigint").alias("x1"))
    both = walls.shared_ink(ink.drop("thin"), mask, PLAN).select("plan_id", F.col("shared").cast("bigint").alias("shared"))
    return walls.coverage(ink, mask, PLAN).select("plan_id", F.round("coverage", 9).alias("coverage")).join(R.large(both), "plan_id")


def _filled(h: DataFrame, x1: Column) -> DataFrame:
    return h.select("plan_id", F.explode(F.sequence(F.lit(18).cast("bigint"), (F.col("h") + 22).cast("bigint"))).alias("y"), F.lit(18).cast("bigint").alias("x0"), x1.cast("bigint").alias("x1"))


@query(f"WITH {_H}, a AS (SELECT *, 2 + k % 5 AS e FROM h) SELECT k AS plan_id, e * (h + 5) AS area, round(e / (w + 5), 9)::DOUBLE AS share FROM a WHERE e / (w + 5) >= 0.02")
def thin_structures(spark: SparkSession, d: str) -> DataFrame:
    """What the widest outline encloses beyond the chosen one, where that is two hundredths of it or more."""
    h = houses(spark, d)
    wide, best = _filled(h, F.col("w") + 24 + F.col("plan_id") % 5), _filled(h, F.col("w") + 22)
    return walls.excluded(wide, best, PLAN).select("plan_id", F.col("area").cast("bigint").alias("area"), F.round("share", 9).alias("share"))


@query("""
WITH RECURSIVE a AS (SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, ((floor(l_discount * 100 + 0.5) * 0.08::DOUBLE + 0.1::DOUBLE) * CASE WHEN l_partkey % 3 = 0 THEN 0.7 ELSE 1 END::DOUBLE)::DOUBLE AS e, l_partkey % 4 AS held FROM lineitem),
b AS (
  SELECT plan_id, i, i AS round, held, e FROM a WHERE i = 1
  UNION ALL
  SELECT plan_id, i, CASE WHEN t THEN i ELSE round END, CASE WHEN t THEN h2 ELSE held END, CASE WHEN t THEN e2 ELSE e END FROM (SELECT b.plan_id, a.i, b.round, b.held, b.e, a.held AS h2, a.e AS e2, a.held >= b.held AND a.e > b.e + 0.001::DOUBLE AS t FROM b JOIN a ON a.plan_id = b.plan_id AND a.i = b.i + 1)
)
SELECT plan_id, arg_max(round, i) AS round, arg_max(held, i) AS held, arg_max(e, i) AS effective FROM b GROUP BY plan_id""")
def accepted_attempts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    one = V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    # the SQL leaves equal lines in any order: the discount makes it one order, whatever the files' order is
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount")
    a = one.select(
        F.col("l_orderkey").alias("plan_id"), F.row_number().over(order).cast("bigint").alias("round"), (F.floor(F.col("l_discount") * 100 + 0.5) * 0.08 + 0.1).alias("confidence"),
        F.when(F.col("l_partkey") % 3 == 0, 0.7).otherwise(1.0).alias("factor"), (F.col("l_partkey") % 4).alias("held"),
    )
    return walls.best_attempts(a).select("plan_id", "round", "held", "effective")


@query("""
WITH RECURSIVE f AS (SELECT DISTINCT l_orderkey AS plan_id, l_partkey AS floor, (l_partkey * 37 % 90)::DOUBLE AS x0, (l_partkey * 53 % 70)::DOUBLE AS y0 FROM lineitem), g AS (SELECT *, y0 + 10 + floor % 25 AS y1, row_number() OVER (PARTITION BY plan_id ORDER BY y0, x0, floor) AS i FROM f),
s AS (
  SELECT plan_id, i, y0 AS a, y1 AS b, 0 AS r, floor, x0 FROM g WHERE i = 1
  UNION ALL
  SELECT plan_id, i, CASE WHEN same THEN least(a, y0) ELSE y0 END, CASE WHEN same THEN greatest(b, y1) ELSE y1 END, CASE WHEN same THEN r ELSE r + 1 END, floor, x0 FROM (SELECT g.*, s.a, s.b, s.r, least(s.b, g.y1) - greatest(s.a, g.y0) > 0.3 * least(s.b - s.a, g.y1 - g.y0) AS same FROM s JOIN g ON g.plan_id = s.plan_id AND g.i = s.i + 1)
)
SELECT plan_id, floor, row_number() OVER (PARTITION BY plan_id ORDER BY r, x0, floor) - 1 AS place FROM s""")
def ordered_floors(spark: SparkSession, d: str) -> DataFrame:
    """Floors of a drawing in reading order."""
    p = F.col("l_partkey")
    f = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), p.alias("floor"), (p * 37 % 90).cast("double").alias("x0"), (p * 53 % 70).cast("double").alias("y0")).distinct()
    f = f.withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 10 + F.col("floor") % 25})
    return walls.reading_order(f).select("plan_id", "floor", "place")
