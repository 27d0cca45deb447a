"""Ruling lines, rails, windows, strokes, sheets of crops and graded evidence against pixels."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_floods import PLAN, blobs, flood, noise, of, pixels, table

from plumbline.operators import floods, glazing, ruling, strokes, tiles, walls
from plumbline.operators import kernels as K
from plumbline.operators import raster as R
from plumbline.sources.tables import Workspace


def lengths(m):
    """Length of the run down each column that a pixel is in."""
    out = np.zeros(m.shape, int)
    for x in range(m.shape[1]):
        y = 0
        while y < m.shape[0]:
            n = 0
            while y + n < m.shape[0] and m[y + n, x]:
                n += 1
            out[y : y + n, x] = n
            y += max(1, n)
    return out


def lines_along(m):
    size, (lab, stats) = lengths(m), K.label(m)
    thin, mask = m & (size <= ruling.THICK), np.zeros_like(m)
    at = lambda y, x: 0 <= y < m.shape[0] and 0 <= x < m.shape[1]

    def clean(y, a, b):
        bad = n = 0
        for x in range(a, b + 1, 2):
            lo = hi = y
            while at(lo - 1, x) and m[lo - 1, x]:
                lo -= 1
            while at(hi + 1, x) and m[hi + 1, x]:
                hi += 1
            n += 1
            bad += at(lo - 2, x) and m[lo - 2, x] or at(hi + 2, x) and m[hi + 2, x]
        return bad <= 0.25 * n

    def tall_near(p, x, way):
        return any(at(q, x + way * k) and m[q, x + way * k] and size[q, x + way * k] > ruling.THICK for k in range(1, ruling.HYPHEN + 1) for q in (p - 1, p, p + 1))

    def erase(y, a, b):
        for x in range(a, b + 1):
            p = next((q for q in range(y - 2, y + 3) if at(q, x) and thin[q, x]), None)
            if p is None or tall_near(p, x, -1) and tall_near(p, x, 1):
                continue
            top = p
            while at(top - 1, x) and thin[top - 1, x]:
                top -= 1
            mask[top : top + size[p, x], x] = True

    for y in range(m.shape[0]):
        xs = np.flatnonzero(np.diff(np.concatenate([[0], thin[y].astype(int), [0]])))
        segs = [(a, b - 1) for a, b in zip(xs[::2], xs[1::2])]
        chain = []

        def flush(chain, y=y):
            if chain and chain[-1][1] - chain[0][0] >= ruling.SPAN and (len(chain) >= ruling.CHAIN or sum(b - a + 1 for a, b in chain) >= ruling.INK):
                erase(y, chain[0][0], chain[-1][1])

        for a, b in segs:
            n, k = b - a + 1, lab[y, (a + b) // 2]
            flat = stats[k, 4] - stats[k, 2] + 1 <= ruling.THICK
            if n >= ruling.SOLID and clean(y, a, b):
                erase(y, a, b)
            if not (ruling.THICK + 2 <= n <= ruling.DASH if flat else n >= ruling.DASH and clean(y, a, b)):
                continue
            if chain:
                gap = a - chain[-1][1] - 1
                over = sum(any(at(q, x) and thin[q, x] for q in range(y - 2, y + 3)) for x in range(chain[-1][1] + 1, a)) if gap > ruling.GAP else 0
                if gap > ruling.BRIDGE or gap > ruling.GAP and over < 0.12 * gap:
                    flush(chain)
                    chain = []
            chain.append((a, b))
        flush(chain)
    return mask


def ruled(seed, shape=(70, 420)):
    r, m = random.Random(seed), np.zeros(shape, bool)
    for _ in range(4):
        y, x, t = r.randint(2, 62), r.randint(0, 40), r.randint(1, 4)
        while x < 400 and r.random() < 0.97:
            n = r.choice((5, 7, 12, 12, 20, 47, 50))
            m[y : y + t, x : x + n] = True
            x += n + r.choice((4, 8, 8, 23, 24, 25, 60))
    for _ in range(3):
        y, x = r.randint(2, 62), r.randint(0, 250)
        m[y : y + r.randint(1, 3), x : x + r.randint(80, 160)] = True
    for _ in range(25):
        y, x = r.randint(0, 60), r.randint(0, 410)
        m[y : y + r.randint(3, 12), x : x + r.randint(1, 7)] = True
    return m


def test_ruling_lines(spark):
    masks = [ruled(k) for k in range(6)] + [ruled(9).T.copy(), noise(4, 0.3, (30, 40))]
    want = of([lines_along(m) | lines_along(m.T).T for m in masks])
    assert pixels(ruling.ruling_lines(table(spark, masks), PLAN, Workspace(spark, "t"))) == want and len(want) > 2000


def without_rails(m, lo_margin, hi_margin):
    n, cols = m.shape[1], np.flatnonzero(m.any(axis=0))
    bands = []
    for x in cols:
        if bands and x - bands[-1][1] <= 2:
            bands[-1][1] = x
        else:
            bands.append([x, x])
    if bands and n - 1 - bands[-1][1] <= 1:
        bands[-1][1] = n - 1
    tall = [int(np.flatnonzero(m[:, a : b + 1].any(axis=1)).max() - np.flatnonzero(m[:, a : b + 1].any(axis=1)).min() + 1) for a, b in bands]
    if len(bands) < 2:
        return m
    t = tall[max(range(len(bands)), key=lambda k: (bands[k][1] - bands[k][0], -k))]

    def rail(k, inner):
        (a, b), (c, d) = bands[k], bands[inner]
        gap = c - b if b < c else a - d
        if b - a + 1 > max(2, 0.25 * t) or t >= 12 and 0.55 * t <= tall[k] < 1.2 * t and gap < 0.9 * t:
            return False
        return lo_margin > 0 and b < lo_margin or hi_margin > 0 and a > n - 1 - hi_margin or gap >= 0.9 * t or tall[k] >= 1.2 * t

    lo, hi = 0, len(bands) - 1
    while lo < hi and rail(lo, lo + 1):
        lo += 1
    while hi > lo and rail(hi, hi - 1):
        hi -= 1
    out = np.zeros_like(m)
    out[:, bands[lo][0] : bands[hi][1] + 1] = m[:, bands[lo][0] : bands[hi][1] + 1]
    return out


def test_rails(spark):
    masks = []
    for seed in range(24):
        r, m = random.Random(seed), np.zeros((30, 150), bool)
        for x in range(40, r.randint(60, 110), 7):
            m[8 : 8 + r.choice((6, 14)), x : x + r.randint(2, 6)] = True
        for _ in range(r.randint(0, 4)):
            x, h = r.choice((r.randint(0, 38), r.randint(110, 148))), r.choice((4, 9, 14, 20, 30))
            m[(30 - h) // 2 : (30 - h) // 2 + h, x : x + r.choice((1, 2, 3, 5))] = True
        masks.append(m)
    size = spark.createDataFrame([(p, m.shape[1]) for p, m in enumerate(masks)], "plan_id long, width long")
    for lo, hi in ((0, 0), (30, 25)):
        want = [without_rails(m, lo, hi) for m in masks]
        assert pixels(ruling.without_rails(table(spark, masks), PLAN, size, lo, hi)) == of(want) and any((a != b).any() for a, b in zip(want, masks))


def test_windows_go_on_as_walls(spark):
    m = np.zeros((80, 120), bool)
    m[20:25, 5:40] = m[20:25, 64:110] = True  # a wall with a window of 24
    m[60:65, 5:40] = m[59:66, 64:110] = True  # faces within two pixels
    m[40:45, 5:40] = m[36:41, 64:110] = True  # another wall at one end
    g = np.zeros_like(m)
    for y in (20, 60, 40):
        g[y : y + 5, 40:64] = True
    g[5:10, 50:80] = True  # nothing at its ends
    work = Workspace(spark, "t")
    wall, band = table(spark, [m]), table(spark, [g])
    got = {(r.y0, r.x0, r.x1, r.size) for r in glazing.windows(band, wall, PLAN, 5, work).collect()}
    assert got == {(20, 40, 63, 120), (60, 40, 63, 120)}
    full = m.copy()
    full[20:25, 40:64] = full[60:65, 40:64] = True
    assert pixels(glazing.glazed_walls(wall, band, PLAN, 5, work)) == of([full])


def test_tone_and_screen(spark):
    rows = [(1, 0, x, 230 + x % 2, False) for x in range(40)] + [(1, 1, x, 216, False) for x in range(9)] + [(1, 2, x, 218, False) for x in range(9)] + [(1, 3, x, 10, True) for x in range(99)] + [(1, 4, 3, 219, False)]
    cells = spark.createDataFrame(rows, "plan_id long, y long, x long, gray long, ink boolean")
    assert glazing.page_tone(cells, PLAN).collect() == [(1, 230)]
    assert {(r.y, r.x0, r.x1) for r in glazing.screened(cells, PLAN).collect()} == {(1, 0, 8)}


def test_strokes(spark):
    r = random.Random(4)
    drawn = [[[(r.uniform(15, 75), r.uniform(15, 55)) for _ in range(r.randint(1, 6))] for _ in range(3)] for _ in range(6)] + [[[], [(20.5, 20.5)]]]
    rows = [(p, [{"x": x, "y": y} for x, y in s]) for p, per in enumerate(drawn) for s in per]
    paint = strokes.painted(spark.createDataFrame(rows, "plan_id long, points array<struct<x: double, y: double>>"), PLAN)
    masks = []
    for per in drawn:
        m = np.zeros((70, 90), bool)
        for s in per:
            for (ax, ay), (bx, by) in zip(s, s[1:] or s):
                n = max(1, int(np.ceil(max(abs(bx - ax), abs(by - ay)))))
                for k in range(n + 1):
                    m[int(np.floor(ay + (by - ay) * (k / n) + 0.5)), int(np.floor(ax + (bx - ax) * (k / n) + 0.5))] = True
        masks.append(m)
    assert pixels(paint) == of(masks)
    wide = [K.dilate(m, 3) for m in masks]
    band = strokes.band(paint, PLAN, F.lit(3))
    assert pixels(band) == of(wide)
    work = Workspace(spark, "t")
    inside = []
    for m in wide:
        shut = ~K.dilate(~K.dilate(np.pad(m, 9), 2), 2)
        inside.append((shut | ~flood(~shut, np.pad(np.zeros((m.shape[0] + 16, m.shape[1] + 16), bool), 1, constant_values=True)))[9:-9, 9:-9])
    region = work.save(strokes.region(band, PLAN, F.lit(2), work), "inside")
    assert pixels(region) == of(inside)
    outline = [blobs(k, (70, 90)) for k in range(len(masks))]
    got = {r.plan_id: r for r in strokes.fit(table(spark, outline), region, band, PLAN).collect()}
    for p, (o, i, b) in enumerate(zip(outline, inside, wide)):
        core = i & ~b
        miss, spill = 1 - (core & o).sum() / core.sum() if core.any() else 0.0, (o & ~i).sum() / o.sum()
        assert np.allclose((got[p].miss, got[p].spill, got[p].fit), (miss, spill, (1 - miss) * (1 - spill)))
    wall = [noise(20 + k, 0.2, (70, 90)) for k in range(len(masks))]
    told, ink = strokes.networks(band, table(spark, wall), PLAN, 3, work)
    for p, (m, w) in enumerate(zip(wide, wall)):
        lab, stats = K.label(m)
        want = sorted(((m & (lab == k)).sum(), (w & (lab == k)).sum()) for k in range(len(stats)) if (lab == k).sum() >= 48)
        assert sorted((r.size, r.wall_size) for r in told.filter(F.col("plan_id") == p).collect()) == want
        assert {(y, x) for q, y, x in pixels(ink) if q == p} == {(y, x) for y, x in zip(*np.nonzero(m & w)) if (lab == lab[y, x]).sum() >= 48}
    free = {r.plan_id: r for r in strokes.freehand(band, PLAN, 3, work).collect()}
    assert all(r.confidence == strokes.FREEHAND and r.code == "drawn-freehand" for r in free.values()) and set(free) == set(range(len(masks)))


def test_sheets(spark):
    r = random.Random(2)
    crops = [(p, k, r.choice((5, 80, 400, 1500)), r.choice((9, 30, 200, 700, 2500))) for p in range(5) for k in range(20)] + [(9, 1, 0, 5)]
    layout = tiles.laid_out(spark.createDataFrame(crops, "plan_id long, roi_id long, width long, height long"))
    got = layout.collect()
    assert {(t.plan_id, t.roi_id) for t in got} == {(p, k) for p, k, w, _ in crops if w}
    by = {}
    for t in got:
        assert tiles.PAD <= t.x and t.x + t.width <= tiles.SIDE - tiles.PAD and tiles.PAD <= t.y and t.y + t.height <= tiles.SIDE - tiles.PAD
        by.setdefault((t.plan_id, t.sheet), []).append((t.y, t.y + t.height, t.roi_id))
    for rows in by.values():
        rows.sort()
        assert all(b[0] - a[1] == tiles.PAD and b[2] > a[2] for a, b in zip(rows, rows[1:]))
    found = layout.select("plan_id", "sheet", F.concat(F.lit("t"), F.col("roi_id")).alias("text"), (F.col("x") + 1.0).alias("x0"), (F.col("y") + 1.0).alias("y0"), (F.col("x") + F.col("width") - 1.0).alias("x1"), (F.col("y") + F.col("height") - 1.0).alias("y1"))
    off = spark.createDataFrame([(0, 0, "", 20.0, 20.0, 30.0, 30.0), (0, 77, "x", 20.0, 20.0, 30.0, 30.0)], "plan_id long, sheet int, text string, x0 double, y0 double, x1 double, y1 double")
    size, scale = {(p, k): (w, h) for p, k, w, h in crops}, {(t.plan_id, t.roi_id): t.scale for t in got}
    back = tiles.brought_back(found.unionByName(off), layout).collect()
    assert len(back) == len(got)
    for t in back:
        s, (w, h) = scale[t.plan_id, t.roi_id], size[t.plan_id, t.roi_id]
        assert t.text == f"t{t.roi_id}" and abs(t.x0 - 1 / s) < 1e-9 and abs(t.y0 - 1 / s) < 1e-9 and abs(t.x1 - (w - 1 / s)) <= 1 / s and abs(t.y1 - (h - 1 / s)) <= 1 / s


def test_graded_evidence(spark):
    r = np.random.default_rng(8)
    masks = {k: noise(s, n, (40, 40)) for k, s, n in (("thick", 1, 0.01), ("wall", 2, 0.02), ("asserted", 3, 0.03), ("ink", 4, 0.1))}
    at = [(1, 0, e, i, float(x), float(y)) for e in range(4) for i, (x, y) in enumerate(r.uniform(2, 37, (20, 2)))]
    df = spark.createDataFrame(at, "plan_id long, floor int, e int, i int, x double, y double").withColumn("step", F.lit(2.0))
    runs = {k: table(spark, [np.zeros((1, 1), bool), m]) for k, m in masks.items()}
    got = {(t.e, t.i): (t.kind, t.level) for t in walls.graded(df, runs, 2).collect()}
    for _, _, e, i, x, y in at:
        px, py = int(np.floor(x + 0.5)), int(np.floor(y + 0.5))
        kind = next((k for k, m in masks.items() if m[max(0, py - 2) : py + 3, max(0, px - 2) : px + 3].any()), None)
        assert got[e, i] == (kind, walls.GRADES.get(kind, 0.0))
    levels = [got[e, i][1] for e in range(4) for i in range(20)]
    longest = max(len(s) for s in "".join("0" if v <= 0 else " " for v in levels).split(" "))
    one = walls.graded_support(walls.graded(df, runs, 2)).first()
    assert np.isclose(one["mean"], np.mean(levels)) and np.isclose(one.bare, np.mean(np.array(levels) <= 0)) and one.longest == 2.0 * longest
    assert walls.graded(df, {}, 2).agg(F.max("level")).first()[0] == 0.0 and len(floods.boxes(runs["ink"], PLAN).collect()) == 1 and R.ink_bounds(runs["ink"], PLAN).count() == 1
