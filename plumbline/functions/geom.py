"""Points, segments, rings and boxes as Column expressions. A ring is array<struct<x, y>>, closed without saying so; y grows downwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLINEAR = 1e-9  # fixed value
FLAT_WINDING = 1e-5  # fixed value
FLAT_AREA = 1e-4  # fixed value


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def following(ring: Column) -> Column:
    """The ring turned by one: beside each vertex stands the next."""
    return F.when(F.size(ring) > 0, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))).otherwise(ring)


def over_edges(ring: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum over the edges of f(start, end)."""
    return F.aggregate(F.zip_with(ring, following(ring), f), F.lit(0.0), lambda a, v: a + v)


def cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(ring: Column) -> Column:
    """Half the sum of cross products; 0 for fewer than three vertices or null."""
    return F.when(F.size(ring) >= 3, over_edges(ring, cross) / 2).otherwise(F.lit(0.0))


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def net_area_px(ring: Column, holes: Column) -> Column:
    """Area less that of each hole with three vertices or more (array of rings), never below 0."""
    cut = F.aggregate(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), F.lit(0.0), lambda a, h: a + F.when(F.size(h) >= 3, ring_area(h)).otherwise(F.lit(0.0)))
    return F.when(F.size(ring) >= 3, F.greatest(ring_area(ring) - cut, F.lit(0.0))).otherwise(F.lit(0.0))


def live_rings(holes: Column) -> Column:
    """The rings of holes (array<struct<id, ring, source, stale, ...>>) that are subtracted: those not stale."""
    return F.transform(F.filter(holes, lambda h: ~F.coalesce(h["stale"], F.lit(False))), lambda h: h["ring"])


def area_sqft(ring: Column, holes: Column, fx: Column, fy: Column) -> Column:
    """Square feet within the ring less its live holes, at feet per pixel fx, fy; a scale that is not known is 1."""
    return net_area_px(ring, live_rings(holes)) * F.coalesce(fx, F.lit(1.0)) * F.coalesce(fy, F.lit(1.0))


def perimeter(ring: Column, fx: Column | float = 1.0, fy: Column | float = 1.0) -> Column:
    """Closed length at a scale of each axis; 0 for fewer than two vertices."""
    step = lambda a, b: F.sqrt(((b["x"] - a["x"]) * fx) * ((b["x"] - a["x"]) * fx) + ((b["y"] - a["y"]) * fy) * ((b["y"] - a["y"]) * fy))
    return F.when(F.size(ring) >= 2, over_edges(ring, step)).otherwise(F.lit(0.0))


def centroid(ring: Column) -> Column:
    """The centre of area; the mean of the vertices where there is next to none; the origin for no vertices."""
    n, zero = F.size(ring), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s: Column, e: Column) -> Column:
        return F.struct((s["a"] + e["c"]).alias("a"), (s["x"] + (e["p"]["x"] + e["q"]["x"]) * e["c"]).alias("x"), (s["y"] + (e["p"]["y"] + e["q"]["y"]) * e["c"]).alias("y"))

    def told(s: Column) -> Column:
        flat = F.abs(s["a"]) / 2 < FLAT_AREA
        mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / n
        return F.when(flat, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(F.struct((s["x"] / (3 * s["a"])).alias("x"), (s["y"] / (3 * s["a"])).alias("y")))

    pairs = F.zip_with(ring, following(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q"), cross(p, q).alias("c")))
    return F.when(ring.isNull() | (n == 0), zero).otherwise(let(F.aggregate(pairs, sums, step), told))


def bounds(ring: Column) -> Column:
    """struct<x0, y0, x1, y1>, or null for no vertices."""
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    box = F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))
    return F.when(F.size(ring) > 0, box)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct<x0, y0, x1, y1> of doubles."""
    return F.struct(*[c.cast("double").alias(k) for c, k in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def winding(ring: Column) -> Column:
    """CW, CCW or degenerate, as seen with y downwards."""
    turn = over_edges(ring, lambda a, b: (b["x"] - a["x"]) * (b["y"] + a["y"]))
    return F.when(ring.isNull() | (F.size(ring) < 3) | (F.abs(turn) < FLAT_WINDING), F.lit("degenerate")).when(turn < 0, F.lit("CW")).otherwise(F.lit("CCW"))


def wound(ring: Column, target: str = "CCW") -> Column:
    """The ring, reversed if it is wound the other way."""
    return F.when(winding(ring).isin("degenerate", target), ring).otherwise(F.reverse(ring))


def orientation(p: Column, q: Column, r: Column) -> Column:
    """0 collinear, 1 clockwise, 2 counterclockwise."""
    v = (q["y"] - p["y"]) * (r["x"] - q["x"]) - (q["x"] - p["x"]) * (r["y"] - q["y"])
    return F.when(F.abs(v) < COLLINEAR, F.lit(0)).when(v < 0, F.lit(1)).otherwise(F.lit(2))


def on_segment(p: Column, q: Column, r: Column) -> Column:
    """Whether q is in the box of p and r, with a little slack."""
    within = lambda k: q[k].between(F.least(p[k], r[k]) - COLLINEAR, F.greatest(p[k], r[k]) + COLLINEAR)
    return within("x") & within("y")


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a b and c d have a point in common. Their boxes are looked at first: most pairs are apart."""
    o = [orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)]
    touch = ((o[0] == 0) & on_segment(a, c, b)) | ((o[1] == 0) & on_segment(a, d, b)) | ((o[2] == 0) & on_segment(c, a, d)) | ((o[3] == 0) & on_segment(c, b, d))
    apart = lambda k: (F.greatest(a[k], b[k]) < F.least(c[k], d[k]) - 1e-6) | (F.greatest(c[k], d[k]) < F.least(a[k], b[k]) - 1e-6)
    return ~(apart("x") | apart("y")) & (((o[0] != o[1]) & (o[2] != o[3])) | touch)


def folds_back(a: Column, b: Column, c: Column) -> Column:
    """Whether the edges b a and b c leave b in the same direction."""
    x1, y1, x2, y2 = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    return (F.abs(x1 * y2 - y1 * x2) < COLLINEAR) & (x1 * x2 + y1 * y2 > 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and however deep in lambdas the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _odd(p: Column, e: Column) -> Column:
    """Whether a ray to the right of p crosses an odd number of edges (array<struct<a, b, i>>)."""
    hit = lambda u: ((u["a"]["y"] > p["y"]) != (u["b"]["y"] > p["y"])) & (p["x"] < (u["b"]["x"] - u["a"]["x"]) * (p["y"] - u["a"]["y"]) / F.nullif(u["b"]["y"] - u["a"]["y"], F.lit(0.0)) + u["a"]["x"])
    return F.size(F.filter(e, lambda u: F.coalesce(hit(u), F.lit(False)))) % 2 == 1


def in_ring(p: Column, ring: Column) -> Column:
    """Even-odd rule: whether an odd number of edges is crossed by a ray to the right."""
    return F.coalesce((F.size(ring) >= 3) & _odd(p, edges(ring)), F.lit(False))


def in_area(p: Column, ring: Column, holes: Column) -> Column:
    """In the ring and in none of the holes (array of rings)."""
    return in_ring(p, ring) & ~F.exists(holes, lambda h: in_ring(p, h))


def share_inside(inner: Column, outer: Column) -> Column:
    """Share of the vertices of inner that are inside outer; 0 if either is no ring."""
    inside = let(edges(outer), lambda e: F.size(F.filter(inner, lambda v: _odd(v, e))))
    return F.when((F.size(inner) > 0) & (F.size(outer) >= 3), inside / F.size(inner)).otherwise(F.lit(0.0))


def edges(ring: Column) -> Column:
    """array<struct<a, b, i>> of a closed ring."""
    n = F.size(ring)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b"), i.alias("i"))))


def _meets_itself(e: Column) -> Column:
    n = F.size(e)
    near = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) < 1e-10

    def meet(u: Column, v: Column) -> Column:
        after, before = v["i"] == u["i"] + 1, (u["i"] == 0) & (v["i"] == n - 1)
        return near(u["a"], v["a"]) | F.when(after, folds_back(u["a"], u["b"], v["b"])).when(before, folds_back(u["b"], u["a"], v["a"])).otherwise(segments_cross(u["a"], u["b"], v["a"], v["b"]))

    return F.exists(e, lambda u: F.exists(F.slice(e, u["i"] + 2, n), lambda v: meet(u, v)))


def self_intersects(ring: Column) -> Column:
    """Whether two vertices coincide, neighbouring edges fold back on each other, or other edges meet."""
    return F.coalesce((F.size(ring) >= 3) & let(edges(ring), _meets_itself), F.lit(False))


def _cross(ea: Column, eb: Column) -> Column:
    return F.exists(ea, lambda u: F.exists(eb, lambda v: segments_cross(u["a"], u["b"], v["a"], v["b"])))


def rings_cross(a: Column, b: Column) -> Column:
    """Whether any edge of one meets any of the other."""
    return F.coalesce(let(edges(b), lambda eb: _cross(edges(a), eb)), F.lit(False))


# Why a void is refused, the first that holds.
VOID_CORNERS = "A void needs at least three corners"
VOID_NO_OUTLINE = "No closed outline to punch a void out of"
VOID_CROSSES_ITSELF = "The void crosses itself"
VOID_OUTSIDE = "The void must sit inside the outline"
VOID_CROSSES_OUTLINE = "The void crosses the outline"
VOID_OVERLAPS = "The void overlaps another void"


def void_refusal(ring: Column, outer: Column, others: Column) -> Column:
    """Why a ring can't be a void of outer beside the other voids, or null if it can."""

    def judged(er: Column, eo: Column) -> Column:
        clash = F.exists(others, lambda h: (F.size(h) >= 3) & let(edges(h), lambda eh: _cross(er, eh) | F.exists(er, lambda u: _odd(u["a"], eh)) | F.exists(eh, lambda u: _odd(u["a"], er))))
        return (
            F.when(_meets_itself(er), F.lit(VOID_CROSSES_ITSELF))
            .when(F.exists(er, lambda u: ~_odd(u["a"], eo)), F.lit(VOID_OUTSIDE))
            .when(_cross(er, eo), F.lit(VOID_CROSSES_OUTLINE))
            .when(F.coalesce(clash, F.lit(False)), F.lit(VOID_OVERLAPS))
        )

    shaped = let(edges(ring), lambda er: let(edges(outer), lambda eo: judged(er, eo)))
    return F.when(ring.isNull() | (F.size(ring) < 3), F.lit(VOID_CORNERS)).when(outer.isNull() | (F.size(outer) < 3), F.lit(VOID_NO_OUTLINE)).otherwise(shaped)


def boxes_meet(a: Column, b: Column, slack=0.0) -> Column:
    """Closed overlap of two boxes struct<x0, y0, x1, y1>, with slack."""
    return (a["x0"] - slack <= b["x1"]) & (b["x0"] - slack <= a["x1"]) & (a["y0"] - slack <= b["y1"]) & (b["y0"] - slack <= a["y1"])


def box_contains(outer: Column, inner: Column, slack=0.0) -> Column:
    return (inner["x0"] >= outer["x0"] - slack) & (inner["y0"] >= outer["y0"] - slack) & (inner["x1"] <= outer["x1"] + slack) & (inner["y1"] <= outer["y1"] + slack)


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def shared_area(a: Column, b: Column) -> Column:
    side = lambda k: F.greatest(F.least(a[f"{k}1"], b[f"{k}1"]) - F.greatest(a[f"{k}0"], b[f"{k}0"]), F.lit(0.0))
    return side("x") * side("y")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over that of the smaller box; 0 where either has none."""
    least = F.least(box_area(a), box_area(b))
    return F.when(least > 0, shared_area(a, b) / least).otherwise(F.lit(0.0))


def cover_ratio(a: Column, b: Column) -> Column:
    """The share of box b that box a covers."""
    return F.when(box_area(b) > 0, shared_area(a, b) / box_area(b)).otherwise(F.lit(0.0))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance from a point to the nearest point of a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / long))).otherwise(F.lit(0.0))
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def edge_class(a: Column, b: Column, tolerance: float = 14.0) -> Column:
    """h, v or d: an edge within so many degrees of an axis, or neither."""
    deg = F.degrees(F.atan2(F.abs(b["y"] - a["y"]), F.abs(b["x"] - a["x"])))
    return F.when(deg <= tolerance, F.lit("h")).when(deg >= 90 - tolerance, F.lit("v")).otherwise(F.lit("d"))


def line_axis(start: Column, end: Column, tolerance: float = 5.0) -> Column:
    """x, y or diagonal for a drawn line; null for one without length."""
    dx, dy = F.abs(end["x"] - start["x"]), F.abs(end["y"] - start["y"])
    deg = F.degrees(F.atan2(dy, dx))
    return F.when((dx > 0) | (dy > 0), F.when(deg <= tolerance, F.lit("x")).when(deg >= 90 - tolerance, F.lit("y")).otherwise(F.lit("diagonal")))


def moved_in(ring: Column, insets: Column) -> Column:
    """The ring with every edge moved inwards by its own inset: vertices are where neighbouring edges meet then; where they are parallel, the vertex moves with its edge."""
    side = F.when(signed_area(ring) >= 0, 1.0).otherwise(-1.0)

    def line(e: Column, d: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        long = F.nullif(F.hypot(dx, dy), F.lit(0.0))
        nx, ny = -dy / long * side, dx / long * side
        return F.struct((e["a"]["x"] + nx * d).alias("x"), (e["a"]["y"] + ny * d).alias("y"), dx.alias("dx"), dy.alias("dy"))

    def corners(l: Column) -> Column:  # noqa: E741
        def corner(v: Column, i: Column) -> Column:
            u = F.get(l, F.pmod(i - 1, F.size(l)))
            k = u["dx"] * v["dy"] - u["dy"] * v["dx"]
            t = ((v["x"] - u["x"]) * v["dy"] - (v["y"] - u["y"]) * v["dx"]) / F.when(F.abs(k) > 1e-9, k)
            return F.struct(F.coalesce(u["x"] + t * u["dx"], v["x"]).alias("x"), F.coalesce(u["y"] + t * u["dy"], v["y"]).alias("y"))

        return F.transform(l, corner)

    return let(F.zip_with(edges(ring), insets, line), corners)
