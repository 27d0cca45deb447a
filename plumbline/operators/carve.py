"""Parts of an outline that are no living area: found by labels, by shading and by the look of a garage, weighed against each other, and cut out.

Masks are bool arrays. A region is (mask, type, confidence, source); where two overlap by half of the smaller they are one, and their evidence adds up.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from plumbline.operators import kernels as K

# Confidences of the sources, and limits of what may be cut.
LABELLED, LABELLED_OPEN, GARAGE, SHADED = 0.9, 0.7, 0.65, 0.5
SAME, MOST_CUT, LEAST_LEFT, VOID = 0.5, 0.5, 0.35, 0.002


class Region(NamedTuple):
    mask: np.ndarray
    type: str
    confidence: float
    source: str


def cavities(footprint: np.ndarray, barrier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of what is inside the footprint and not barred, and their figures."""
    return K.label(footprint & ~barrier)


def around(lab: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> int:
    """The component that most of a 5 by 5 grid of points in a box lies in, or -1."""
    xs = np.clip((x0 + (np.arange(5) + 0.5) / 5 * (x1 - x0)).astype(int), 0, lab.shape[1] - 1)
    ys = np.clip((y0 + (np.arange(5) + 0.5) / 5 * (y1 - y0)).astype(int), 0, lab.shape[0] - 1)
    got = lab[ys[:, None], xs[None, :]].ravel()
    got = got[got >= 0]
    return int(np.bincount(got).argmax()) if len(got) else -1


def shaded(gray: np.ndarray, footprint: np.ndarray, ink: np.ndarray, step: int = 12, least: float = 0.02) -> list[np.ndarray]:
    """Even grey pockets: darker than the page by a step, large, and of nearly one level."""
    inside = footprint & ~ink
    if not inside.any():
        return []
    page = int(np.bincount(gray[inside], minlength=256).argmax())
    lab, stats = K.label(inside & (gray < page - step))
    out = []
    for i, s in enumerate(stats):
        if s[0] < least * footprint.sum() or min(s[3] - s[1], s[4] - s[2]) < 8 or s[0] < 0.5 * (s[3] - s[1] + 1) * (s[4] - s[2] + 1):
            continue
        m = lab == i
        lo, hi = np.percentile(gray[m], [10, 90])
        if hi - lo <= 10:
            out.append(m)
    return out


def garage_like(m: np.ndarray, footprint: np.ndarray, ink: np.ndarray, wall: np.ndarray) -> bool:
    """Whether a cavity looks like a garage: a middling, solid, nearly empty rectangle with one side that is thin, as a door is drawn, and walls on the others."""
    ys, xs = np.nonzero(m)
    x0, y0, x1, y1 = xs.min(), ys.min(), xs.max(), ys.max()
    w, h, size = x1 - x0 + 1, y1 - y0 + 1, len(ys)
    if not 0.05 <= size / footprint.sum() <= 0.45 or size < 0.7 * w * h or max(w, h) > 4 * min(w, h):
        return False
    if (ink[y0 : y1 + 1, x0 : x1 + 1] & ~m[y0 : y1 + 1, x0 : x1 + 1]).sum() > 0.04 * w * h:
        return False

    def depth(strip: np.ndarray) -> np.ndarray:
        """How far wall goes on outwards from the edge; strip's first axis goes outwards."""
        stop = np.argmax(~np.vstack([strip, np.zeros((1, strip.shape[1]), bool)]), axis=0)
        return stop

    reach = 14
    p = np.pad(wall, reach)
    ax, ay, bx, by = x0 + reach, y0 + reach, x1 + reach, y1 + reach
    sides = [p[ay - reach : ay, ax : bx + 1][::-1], p[by + 1 : by + 1 + reach, ax : bx + 1], p[ay : by + 1, ax - reach : ax].T[::-1], p[ay : by + 1, bx + 1 : bx + 1 + reach].T]
    depths = [depth(s) for s in sides]
    usual = np.median(np.concatenate([d[d > 0] for d in depths])) if any((d > 0).any() for d in depths) else 0
    doors = [float(((d > 0) & (d <= 0.5 * usual)).mean()) for d in depths]
    walled = [float((d > 0).mean()) for d in depths]
    k = int(np.argmax(doors))
    return doors[k] >= 0.4 and all(walled[i] >= 0.55 for i in range(4) if i != k)


def regions(footprint: np.ndarray, wall: np.ndarray, ink: np.ndarray, gray: np.ndarray | None, marks: list[tuple[str, float, float, float, float]], auto: bool = True) -> list[Region]:
    """Regions of a footprint. marks: type and box (x0, y0, x1, y1) of labels of what is no living area."""
    lab, stats = cavities(footprint, wall)
    shut, _ = cavities(footprint, K.close(wall, max(2, K.thickness(wall))))  # doors closed
    found = []
    for kind, *box in marks:
        i, j = around(shut, *box), around(lab, *box)
        if i >= 0 and (shut == i).sum() < MOST_CUT * footprint.sum():
            found.append(Region(shut == i, kind, LABELLED, "label"))
        elif j >= 0 and stats[j, 0] < MOST_CUT * footprint.sum():
            found.append(Region(lab == j, kind, LABELLED_OPEN, "label"))
    if auto:
        found += [Region(m, "garage", GARAGE, "garage") for m in (lab == i for i in range(len(stats)) if stats[i, 0] > 0.05 * footprint.sum()) if garage_like(m, footprint, ink, wall)]
    if gray is not None:
        found += [Region(m, "porch", SHADED, "shade") for m in shaded(gray, footprint, ink)]
    return arbitrated(found)


def arbitrated(found: list[Region]) -> list[Region]:
    """Regions that share half of the smaller are one, of the surest's type; each further source takes its share of the doubt. The surest come first."""
    out: list[Region] = []
    for r in sorted(found, key=lambda r: (-r.confidence, -int(r.mask.sum()))):
        for k, s in enumerate(out):
            if (r.mask & s.mask).sum() >= SAME * min(r.mask.sum(), s.mask.sum()):
                out[k] = Region(s.mask | r.mask, s.type, 1 - (1 - s.confidence) * (1 - r.confidence), s.source)
                break
        else:
            out.append(r)
    return sorted(out, key=lambda r: -r.confidence)


def carved(footprint: np.ndarray, found: list[Region], wall_width: int = 3) -> tuple[np.ndarray, list[Region], list[np.ndarray]]:
    """(footprint left, regions cut, voids): regions go with the walls around them, the surest first, as long as no more than MOST_CUT is cut and the largest part
    left is LEAST_LEFT of the whole; one that doesn't fit is passed over, and smaller ones may still fit. What is cut inside is a void."""
    left, cut, voids, whole = footprint.copy(), [], [], footprint.sum()
    gone = 0
    for r in found:
        m = K.dilate(r.mask, wall_width) & left
        if not m.any() or gone + m.sum() > MOST_CUT * whole:
            continue
        rest = K.open_(left & ~m, wall_width)  # walls that stood around what is gone go too
        lab, stats = K.label(rest)
        if not len(stats) or stats[:, 0].max() < LEAST_LEFT * whole:
            continue
        gone += int(m.sum())
        left = lab == int(stats[:, 0].argmax())
        cut.append(r)
    lab, stats = K.label(~K.outside(left) & ~left)
    voids = [lab == i for i in range(len(stats)) if stats[i, 0] >= VOID * whole]
    return left, cut, voids
