"""From drawings to outlines: a candidate table from kernels, one group of rows for each drawing; scores, choice and confidence as Catalyst expressions.

images: plan_id, width, height, data (RGBA bytes). A drawing's wall networks are tried under several hypotheses (all ink or only what is structural; with openings welded, as it is, or with walls
at full length), each at a ladder of closing radii; each rung is a candidate with its ring and what speaks for it. The dearer hypotheses are tried for the networks alone that no cheap one
closes. ranking.score, pick and confidence then choose one for each network, and floors() tells the rings in original pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.operators import kernels as K
from plumbline.operators import ranking, validate
from plumbline.operators import walls as wall_tables
from plumbline.sources.tables import Workspace

CANDIDATES = (
    "plan_id bigint, net bigint, radius double, max_radius double, area double, parts bigint, seal double, support double, longest_gap double, perimeter double, coverage double, "
    "bridged_span double, wall_area double, bbox_area double, structural double, scale double, variant string, policy string, ring array<struct<x: double, y: double>>"
)
WORKING, NETS, GROWTH = 1400, 5, 1.45
# A seal below this asks for the dearer hypotheses; limits of what counts as structural, of openings, flanks and probes, by a network's size and wall thickness.
SEALED, STRUCTURAL = 0.9, (0.2, 0.95)


def walls(ink: np.ndarray) -> tuple[np.ndarray, int]:
    """(long or thick ink, usual thickness): text, dots and hatching are neither."""
    t = K.thickness(ink)
    least = max(12, 4 * t)
    out = K.long_runs(ink, least) | K.long_runs(ink, least, "v") | K.long_runs(ink, least, "d") | K.long_runs(ink, least, "a")
    if t >= 3:
        out |= K.open_(ink, t // 3)
    return out & ink, t


def networks(wall: np.ndarray, t: int) -> list[np.ndarray]:
    """The masks of groups of walls that stand close, the largest first; small ones beside it are no buildings."""
    lab, stats = K.label(K.dilate(wall, max(6, 2 * t)))
    if not len(stats):
        return []
    ink = np.bincount(lab[wall], minlength=len(stats))
    boxes = (stats[:, 3] - stats[:, 1]) * (stats[:, 4] - stats[:, 2])
    order = [i for i in np.argsort(-boxes, kind="stable") if boxes[i] >= 0.1 * boxes.max() and boxes[i] >= 0.008 * wall.size and ink[i]]
    return [wall & (lab == i) for i in order[:NETS]]


def hypotheses(net: np.ndarray, t: int, dear: bool) -> list[tuple[str, str, np.ndarray, float]]:
    """(variant, policy, mask, bridged span) of a network's crop. Those that change nothing are left out."""
    longer, shorter = max(net.shape), min(net.shape)
    weld = lambda m: K.bridge(m, max(24, 12 * t, round(0.3 * longer)), max(8, 2 * t), max(16, round(0.12 * shorter)))
    thick = max(1, round(0.3 * t))
    structural = K.open_(net, thick) if thick >= 2 else net
    apart = thick >= 2 and STRUCTURAL[0] * net.sum() <= structural.sum() <= STRUCTURAL[1] * net.sum()
    out = []
    if not dear:
        welded = weld(net)
        out.append(("all", "weld", welded, 0.0))
        if (welded != net).any():
            out.append(("all", "raw", net, 0.0))
        if apart:
            out.append(("structural", "weld", weld(structural), 0.0))
        return out
    for variant, m in (("all", net), *([("structural", structural)] if apart else [])):
        full, longest = K.spans(m, max(12, round(0.03 * longer)), max(8, 3 * max(4, t)), round(0.55 * longer))
        welded = weld(m)
        if (full & ~welded).any():
            out.append((variant, "span", full | welded, longest))
    return out


def structural_share(net: np.ndarray, t: int) -> float:
    """Of a network's ink, what is no hairline beside walls of thickness t."""
    thick = max(1, round(0.3 * t))
    return float(K.open_(net, thick).sum() / max(1, net.sum())) if thick >= 2 else 1.0


def candidate_rows(plan_id: int, rgba: np.ndarray, dear: bool = False, only: set[int] | None = None) -> list[tuple]:
    """Rows of CANDIDATES for one drawing; of the numbered networks only, if told."""
    ink, scale, _ = K.binarize(rgba, WORKING)
    wall, t = walls(ink)
    rows = []
    for number, net in enumerate(networks(wall, t)):
        if only is not None and number not in only:
            continue
        ys, xs = np.nonzero(net)
        x0, y0, x1, y1 = xs.min(), ys.min(), xs.max(), ys.max()
        crop = net[y0 : y1 + 1, x0 : x1 + 1]
        box, total, structural = float(crop.size), int(crop.sum()), structural_share(crop, t)
        most = max(4, int(0.12 * max(crop.shape)))
        for variant, policy, mask, bridged in hypotheses(crop, t, dear):
            r, seen = max(1, t // 2), -1.0
            while r <= most:
                lab, stats = K.label(K.enclosed(mask, r))
                best = int(stats[:, 0].argmax()) if len(stats) else -1
                size = float(stats[best, 0]) if len(stats) else 0.0
                if size and (seen < 0 or abs(size - seen) > 0.005 * seen):
                    seen = size
                    body = lab == best
                    ring, _ = K.fit(K.simplify_ring(K.outline(body), max(1.5, 0.6 * t)))
                    if len(ring) >= 3:
                        share, gap = K.support(ring, crop, max(2, round(0.9 * t)))
                        bb = (stats[best, 3] - stats[best, 1] + 1) * (stats[best, 4] - stats[best, 2] + 1)
                        held = int((crop & body).sum())
                        cover = min(1.0, bb / box)
                        # what is enclosed beyond the ink itself tells whether the walls close
                        seal = float(np.sqrt(cover * size / bb)) * (1.0 if size - held > 0.2 * size else 0.3)
                        d = np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum()
                        corners = [{"x": float(p[0] + x0), "y": float(p[1] + y0)} for p in ring]
                        rows.append((plan_id, number, float(r), float(most), size, len(stats), seal, share, gap, float(d), held / max(1, total), bridged, box, float(bb), structural, scale, variant, policy, corners))
                r = int(round(GROWTH * r)) + 1
    return rows


_NAMES = [c.split()[0] for c in CANDIDATES.split(", ") if " " in c and not c.startswith("y:")]


def candidates(images: DataFrame) -> DataFrame:
    """The candidate table: one row for each drawing, network, cheap hypothesis and rung that changes the enclosed area. A drawing without walls has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                rgba = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1)
                yield pd.DataFrame(candidate_rows(row.plan_id, rgba), columns=_NAMES)

    return images.select("plan_id", "width", "height", "data").mapInPandas(run, CANDIDATES)


def rescued(images: DataFrame, nets: DataFrame) -> DataFrame:
    """Candidates of the dearer hypotheses, for some networks (plan_id, net) of the drawings."""
    per = nets.groupBy("plan_id").agg(F.collect_set("net").alias("nets"))  # NETS at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                rgba = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1)
                yield pd.DataFrame(candidate_rows(row.plan_id, rgba, True, {int(n) for n in row.nets}), columns=_NAMES)

    # pictures are made by Python, so Spark takes them to be small: they are never the side that is held in memory or sorted
    return images.select("plan_id", "width", "height", "data").join(per.hint("shuffle_hash"), "plan_id").mapInPandas(run, CANDIDATES)


def candidate_table(images: DataFrame, work: Workspace) -> DataFrame:
    """Candidates of the cheap hypotheses, and of the dearer ones for networks that no cheap one seals."""
    cheap = work.save(candidates(images), "cheap")
    open_ = cheap.groupBy("plan_id", "net").agg(F.max("seal").alias("s")).filter(F.col("s") < SEALED).select("plan_id", "net")
    return cheap.unionByName(work.save(rescued(images, open_), "dear"))


def fitted(c: DataFrame, points: DataFrame) -> DataFrame:
    """c with fit: of the points (plan_id, x, y, in original pixels) that any candidate of a network holds, the share that each one holds; null where there are none."""
    at = F.struct((F.col("x") * F.col("scale")).alias("x"), (F.col("y") * F.col("scale")).alias("y"))
    pair = c.select("plan_id", "net", "variant", "policy", "radius", "ring", "scale").join(points.withColumn("p", F.struct("x", "y")), "plan_id").withColumn("in", geom.in_ring(at, F.col("ring")).cast("int"))
    known = pair.withColumn("any", F.max("in").over(W.partitionBy("plan_id", "net", "p"))).filter("any = 1")
    by = ["plan_id", "net", "variant", "policy", "radius"]
    return c.join(known.groupBy(*by).agg(F.avg("in").alias("fit")), by, "left")


def floors(images: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(plan_id, floor, ring, area_px, variant, policy, radius, score, confidence, codes, rejected): the outlines of a drawing in original pixels, in reading order. Legends and title blocks are none of them: rejected tells how many there were.

    points: plan_id, x, y of places known to be inside, as labels of rooms are; candidates that hold more of them score higher, and an outline that holds one is no legend.
    """
    by, ladder = ["plan_id", "net"], ["plan_id", "net", "variant", "policy"]
    c = candidate_table(images, Workspace(images.sparkSession, "floors"))
    whole = ranking.ladder_reference(c, ladder)
    none = F.lit(None).cast("double")
    c = fitted(c, points) if points is not None else c.withColumn("fit", none)
    c = c.join(whole, ladder).withColumns({"completeness": F.least(F.lit(1.0), F.col("area") / F.col("reference")), "brush_fit": none, "drawn": F.lit(False)})
    best = ranking.confidence(ranking.pick(ranking.score(c), by).filter("place = 1"))
    ring = F.transform("ring", lambda p: F.struct((p["x"] / F.col("scale")).alias("x"), (p["y"] / F.col("scale")).alias("y")))
    real = validate.buildings(best.withColumns({"ring": ring, "floor": F.col("net"), "held": F.col("fit") > 0})).filter("building")
    out = real.withColumn("_b", geom.bounds(F.col("ring"))).select("*", *[F.col(f"_b.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])
    placed = wall_tables.reading_order(out.drop("place"))
    return placed.select("plan_id", F.col("place").alias("floor"), "ring", geom.ring_area(F.col("ring")).alias("area_px"), "variant", "policy", "radius", "score", "confidence", "codes", "rejected")
