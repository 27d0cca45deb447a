"""Grey pictures made ready for a recogniser, and the places in them where text may stand: numpy kernels on (height, width) arrays."""

from __future__ import annotations

import numpy as np

from plumbline.operators import kernels as K


def scaled(g: np.ndarray, factor: float) -> np.ndarray:
    """Larger by bilinear interpolation, smaller by means of boxes; fractions are cut off."""
    h, w = g.shape
    nh, nw = max(1, round(h * factor)), max(1, round(w * factor))
    if factor < 1:
        rows, cols = np.minimum(np.arange(nh) * h // nh, h - 1), np.minimum(np.arange(nw) * w // nw, w - 1)
        total = np.add.reduceat(np.add.reduceat(g.astype(np.int64), rows, axis=0), cols, axis=1)
        n = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))[None, :]
        return (total // n).astype(np.uint8)
    y, x = np.clip((np.arange(nh) + 0.5) / factor - 0.5, 0, h - 1), np.clip((np.arange(nw) + 0.5) / factor - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx, f = (y - y0)[:, None], (x - x0)[None, :], g.astype(float)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    low = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return (top * (1 - fy) + low * fy).astype(np.uint8)


def unsharp(g: np.ndarray, amount: float = 0.6) -> np.ndarray:
    """What a 3 by 3 Gaussian takes away, added again by an amount; the border stays."""
    if min(g.shape) < 3:
        return g.copy()
    f = g.astype(np.int32)
    blur = sum(wy * wx * f[1 + dy : f.shape[0] - 1 + dy, 1 + dx : f.shape[1] - 1 + dx] for dy, wy in ((-1, 1), (0, 2), (1, 1)) for dx, wx in ((-1, 1), (0, 2), (1, 1))) / 16
    out = g.copy()
    mid = f[1:-1, 1:-1]
    out[1:-1, 1:-1] = np.clip(mid + amount * (mid - blur), 0, 255).astype(np.uint8)
    return out


def median3(g: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours, the border repeated."""
    p = np.pad(g, 1, mode="edge")
    return np.median(np.stack([p[a : a + g.shape[0], b : b + g.shape[1]] for a in range(3) for b in range(3)]), axis=0).astype(np.uint8)


def clahe(g: np.ndarray, tiles: int = 8, clip: float = 3.0) -> np.ndarray:
    """Histogram equalisation in tiles, with counts above clip times the mean dealt out to all levels, and tables blended between tiles' middles."""
    h, w = g.shape
    ty, tx = min(tiles, h), min(tiles, w)
    ys, xs = np.arange(ty + 1) * h // ty, np.arange(tx + 1) * w // tx
    tables = np.empty((ty, tx, 256))
    for i in range(ty):
        for j in range(tx):
            part = g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * part.size / 256)
            over = np.maximum(n - most, 0).sum()
            tables[i, j] = np.cumsum(np.minimum(n, most) + over / 256) * 255 / part.size
    at = lambda n, edges, k: np.clip(np.interp(np.arange(n), (edges[:-1] + edges[1:] - 1) / 2, np.arange(k)), 0, k - 1)
    fy, fx = at(h, ys, ty), at(w, xs, tx)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    pick = lambda a, b: tables[a[:, None], b[None, :], g]
    out = (pick(y0, x0) * (1 - wx) + pick(y0, x1) * wx) * (1 - wy) + (pick(y1, x0) * (1 - wx) + pick(y1, x1) * wx) * wy
    return np.clip(out, 0, 255).astype(np.uint8)


def stretch(g: np.ndarray, lo: float = 0.01, hi: float = 0.99) -> np.ndarray:
    """Levels drawn out between two shares of the pixels."""
    c = np.cumsum(np.bincount(g.ravel(), minlength=256))
    a, b = int(np.searchsorted(c, lo * g.size)), int(np.searchsorted(c, hi * g.size))
    return g.copy() if b <= a else np.clip((g.astype(np.int32) - a) * 255 // (b - a), 0, 255).astype(np.uint8)


def binary(g: np.ndarray) -> np.ndarray:
    """0 for ink, 255 for paper."""
    return np.where(g <= K.ink_threshold(g), 0, 255).astype(np.uint8)


def framed(g: np.ndarray, margin: int) -> np.ndarray:
    return np.pad(g, margin, constant_values=255)


def without_structure(ink: np.ndarray, longest: int = 72) -> np.ndarray:
    """Ink without runs that are too long for letters, along rows or columns."""
    return ink & ~(K.long_runs(ink, longest) | K.long_runs(ink, longest, "v"))


def center_band(ink: np.ndarray) -> np.ndarray:
    """Of the bands of rows with ink, the one that fills most of the middle third; the rest is cleared."""
    rows = ink.any(axis=1)
    _, a, b = K.runs(rows[None, :])
    if not len(a):
        return ink.copy()
    h = len(rows)
    share = np.minimum(b, 2 * h // 3) - np.maximum(a, h // 3)
    k = int(np.argmax(share))
    out = np.zeros_like(ink)
    out[a[k] : b[k] + 1] = ink[a[k] : b[k] + 1]
    return out


def glyphs(ink: np.ndarray, least: int = 3, tallest: int = 60) -> np.ndarray:
    """(x0, y0, x1, y1, size) of 8-connected pieces of ink that may be letters: of a letter's size, not solid blocks, not at the border."""
    _, s = K.label(without_structure(ink), diagonal=True)
    if not len(s):
        return np.empty((0, 5), np.int64)
    w, h = s[:, 3] - s[:, 1] + 1, s[:, 4] - s[:, 2] + 1
    inside = (s[:, 1] > 0) & (s[:, 2] > 0) & (s[:, 3] < ink.shape[1] - 1) & (s[:, 4] < ink.shape[0] - 1)
    good = inside & (np.maximum(w, h) >= least) & (h <= tallest) & (w <= tallest) & ~((s[:, 0] > 0.9 * w * h) & (w * h > 150))
    return s[good][:, [1, 2, 3, 4, 0]]


def text_rows(pieces: np.ndarray, gap: float = 1.6) -> np.ndarray:
    """(x0, y0, x1, y1, n) of rows of letters: each goes to the row whose end is nearest, if it is within gap letter heights and level with it."""
    if not len(pieces):
        return np.empty((0, 5), np.int64)
    tall = np.median(pieces[:, 3] - pieces[:, 1] + 1)
    rows: list[list[int]] = []
    for x0, y0, x1, y1, _ in pieces[np.lexsort((pieces[:, 1], pieces[:, 0]))]:
        mid = (y0 + y1) / 2
        near = [(x0 - r[2], k) for k, r in enumerate(rows) if -tall < x0 - r[2] <= gap * tall and r[1] - 0.25 * tall <= mid <= r[3] + 0.25 * tall]
        if near:
            r = rows[min(near)[1]]
            r[:] = [r[0], min(r[1], y0), max(r[2], x1), max(r[3], y1), r[4] + 1]
        else:
            rows.append([x0, y0, x1, y1, 1])
    return np.array(rows, np.int64)


def text_regions(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(rows, columns, letter height): rows of at least two letters, and, of letters in none, columns of at least two."""
    g = glyphs(ink)
    tall = float(np.median(g[:, 3] - g[:, 1] + 1)) if len(g) else 0.0
    rows = text_rows(g)
    rows = rows[rows[:, 4] > 1]
    free = np.array([not ((rows[:, 0] <= p[0]) & (rows[:, 2] >= p[2]) & (rows[:, 1] <= p[1]) & (rows[:, 3] >= p[3])).any() for p in g], bool)
    turned = text_rows(g[free][:, [1, 0, 3, 2, 4]]) if free.any() else np.empty((0, 5), np.int64)
    turned = turned[turned[:, 4] > 1][:, [1, 0, 3, 2, 4]]
    return rows, turned, tall


def corner(dark: np.ndarray, x: int, y: int, reach: int = 15, half: int = 6) -> tuple[int, int] | None:
    """The pixel nearest to (x, y) where one or three of the quadrants around it are dark: a corner of walls; None for none within reach."""
    sat = K.summed(dark)
    best = None
    for py in range(max(half, y - reach), min(dark.shape[0] - half, y + reach + 1)):
        px = np.arange(max(half, x - reach), min(dark.shape[1] - half, x + reach + 1))
        if not len(px):
            continue
        q = np.stack([K.rect_sum(sat, px + a, py + b, px + a + half - 1, py + b + half - 1) for a, b in ((-half, -half), (0, -half), (-half, 0), (0, 0))]) / half**2
        n, score = (q > 0.5).sum(axis=0), np.maximum(q, 1 - q).sum(axis=0)
        good = ((n == 1) | (n == 3)) & (score >= 3.6)
        for k in np.flatnonzero(good):
            d = (int(px[k]) - x) ** 2 + (py - y) ** 2
            if best is None or (d, -score[k]) < best[0]:
                best = ((d, -float(score[k])), (int(px[k]), py))
    return best and best[1]
