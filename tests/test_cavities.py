"""Sides of cavities, garages and rooms between labels against plain scans."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F
from test_floods import blobs, noise, table

from plumbline.operators import cavities
from plumbline.operators import kernels as K


def scan(lab, k, foot, wall, t):
    """Step by step outwards from each position of each side."""
    ys, xs = np.nonzero(lab == k)
    band, thin = 3 * t + 6, max(2, int(0.4 * t + 0.5))
    need = max(thin + 1, int(0.6 * t + 0.5))
    out = {}
    for side, (dy, dx) in {"left": (0, -1), "right": (0, 1), "top": (-1, 0), "bottom": (1, 0)}.items():
        doors = walls = run = best = 0
        flat = dx != 0
        span = range(ys.min(), ys.max() + 1) if flat else range(xs.min(), xs.max() + 1)
        for pos in span:
            line = xs[ys == pos] if flat else ys[xs == pos]
            if not len(line):
                run = 0
                continue
            edge = line.min() if dx + dy < 0 else line.max()
            n, left = 0, None
            for s in range(1, band + 1):
                y, x = (pos, edge + dx * s) if flat else (edge + dy * s, pos)
                if not (0 <= y < foot.shape[0] and 0 <= x < foot.shape[1] and foot[y, x]):
                    left = s
                    break
                n += wall[y, x]
            if left and n <= thin and left <= thin + 4:
                doors, run = doors + 1, run + 1
                best = max(best, run)
            else:
                run = 0
            walls += n >= need
        out[side] = (len(span), doors / len(span), best, walls / len(span))
    return out


def test_sides_and_ink(spark):
    t, feet, walls, inks, cav = 4, [], [], [], []
    for seed in range(4):
        foot = blobs(seed, (50, 60)) | blobs(seed + 40, (50, 60))
        wall = foot & noise(seed + 60, 0.35, (50, 60))
        feet.append(foot), walls.append(wall), inks.append(noise(seed + 80, 0.1, (50, 60)))
        cav.append(K.label(foot & ~wall)[0])
    rows, want, share = [], {}, {}
    for p, lab in enumerate(cav):
        for k in range(lab.max() + 1):
            rows += [(p, k, int(y), int(x)) for y, x in zip(*np.nonzero(lab == k))]
            want.update({(p, k, s): v for s, v in scan(lab, k, feet[p], walls[p], t).items()})
            share[p, k] = (int((lab == k).sum()), inks[p][lab == k].mean())
    from plumbline.operators import raster as R

    c = R.islands(spark.createDataFrame(rows, "plan_id long, root long, y long, x long"), ["plan_id", "root", "y"], "x")
    got = {(r.plan_id, r.root, r.side): (r.len, r.door_frac, r.best_run, r.walled_frac) for r in cavities.measured_sides(c, table(spark, feet), table(spark, walls), t).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want) and any(v[2] > 2 for v in want.values()) and any(v[3] > 0 for v in want.values())
    assert {(r.plan_id, r.root): (r["size"], round(r.inked, 9)) for r in cavities.ink_fraction(c, table(spark, inks)).collect()} == {k: (n, round(float(s), 9)) for k, (n, s) in share.items()}


def test_garages(spark):
    t = 8
    foot = np.zeros((200, 300), bool)
    foot[20:180, 20:280] = True
    wall = foot & ~K.dilate(~foot, t)  # the inside
    wall = foot & ~wall
    wall[20:180, 120:128] = True
    wall[92:108, 20:28] = False  # a window
    cut = np.zeros_like(foot)
    cut[40:160, 276:280] = True  # the door of the bay on the right is thin, and flush with its inside
    foot &= ~cut
    wall &= ~cut
    wall[40:160, 272:274] = False
    ink = np.zeros_like(foot)
    lab, stats = K.label(foot & ~wall)
    rows = [(0, int(lab[y, x]), int(y), int(x)) for y, x in zip(*np.nonzero(lab >= 0))]
    from plumbline.operators import raster as R

    c = R.islands(spark.createDataFrame(rows, "plan_id long, root long, y long, x long"), ["plan_id", "root", "y"], "x")
    small = c.join(c.groupBy("root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).filter("n < 17000").select("root"), "root", "left_semi")
    got = cavities.garages(small, table(spark, [foot]), table(spark, [wall]), table(spark, [ink | (lab < -1)]).limit(0), t, 400).collect()
    sides = {k: scan(lab, k, foot, wall, t) for k in set(r[1] for r in rows)}
    want = set()
    for k, s in sides.items():
        n, x0, y0, x1, y1 = (int(v) for v in stats[k])
        w, h = x1 - x0 + 1, y1 - y0 + 1
        if not (max(400, 0.05 * foot.sum()) <= n <= 0.45 * foot.sum() and n < 17000 and n >= 0.7 * w * h and max(w, h) <= 4 * min(w, h)):
            continue
        door = next((d for d in cavities.SIDES if s[d][0] >= 3 * t and s[d][1] >= 0.65 and s[d][2] >= max(2.5 * t, 0.3 * s[d][0])), None)
        if door and sum(s[d][3] for d in cavities.SIDES if d != door) / 3 >= 0.55:
            want.add((0, k, door))
    assert {tuple(r) for r in got} == want


def test_rooms_hold_no_other_label(spark):
    r = random.Random(6)
    labels, walls, limits = [], [], []
    for p in range(12):
        limits.append((p, 0, 0, 200, 150))
        labels += [(p, k, r.randint(5, 195), r.randint(5, 145)) for k in range(r.randint(1, 4))]
        for _ in range(r.randint(4, 16)):
            d = r.choice("hv")
            a = r.randint(0, 150)
            walls.append((p, d, float(r.randint(5, 145)), a, a + r.randint(10, 90), r.choice((2, 4))))
    df = [spark.createDataFrame(x, s) for x, s in ((labels, "plan_id long, label_id long, x long, y long"), (walls, "plan_id long, dir string, center double, lo long, hi long, thickness long"), (limits, "plan_id long, bx0 long, by0 long, bx1 long, by1 long"))]
    got = {(t.plan_id, t.label_id): (t.x0, t.y0, t.x1, t.y1) for t in cavities.clamped_rooms(*df, 30).collect()}
    want = {}
    for p, k, x, y in labels:
        per = []
        for d, own, beside, low, edge in (("v", x, y, True, 0.0), ("v", x, y, False, 200.0), ("h", y, x, True, 0.0), ("h", y, x, False, 150.0)):
            cand = [(abs(own - edge), edge, True)]
            for q, dd, c, lo, hi, t in walls:
                if q == p and dd == d and lo <= beside + 30 and hi >= beside - 30 and (c + t / 2 < own if low else c - t / 2 > own):
                    cand.append((abs(own - c), c + t / 2 if low else c - t / 2, lo <= beside <= hi))
            near = min(f for f, _, full in cand if full)
            per.append({at for f, at, _ in cand if f <= near})
        best = None
        for x0, x1, y0, y1 in itertools.product(*per):
            if any(q == p and j != k and x0 < a < x1 and y0 < b < y1 for q, j, a, b in labels):
                continue
            row = (-(x1 - x0) * (y1 - y0), x0, y0, x1, y1)
            best = min(best or row, row)
        if best:
            want[p, k] = best[1:]
    assert got == want and len(want) > 8
    assert not any(q == p and j != k and b[0] < x < b[2] and b[1] < y < b[3] for (p, k), b in got.items() for q, j, x, y in labels)
