"""Rooms around labels: from a point in a room and the printed lengths to the room's inner faces, and from many rooms to the drawing's scale.

From the label's place the walls on four sides are sought along a band of rays, so that a door in line with the label does not hide one. Each side has a few
stops; of their combinations the one wins whose sides have most wall and whose shape suits the printed lengths best.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import consensus, detect
from plumbline.operators import kernels as K
from plumbline.operators import raster as R

BAND, STOPS, LEAST_COVER = 14, 3, 0.35
ROOMS = "plan_id bigint, label_id bigint, name string, x0 double, y0 double, x1 double, y1 double, confidence double, px double, py double, dim_w double, dim_h double"


def stops(wall: np.ndarray, x: int, y: int, band: int = BAND) -> list[int]:
    """Columns left of x where walls begin along the rays of rows near y, the most frequent first."""
    rows = wall[max(0, y - band) : y + band + 1, : max(x, 0)]
    if not rows.size:
        return []
    hit = rows.shape[1] - 1 - rows[:, ::-1].argmax(axis=1)
    at, n = np.unique(hit[rows.any(axis=1)], return_counts=True)
    return [int(a) for a in at[np.lexsort((-at, -n))][:STOPS]]


def grow(wall: np.ndarray, sat: np.ndarray, x: int, y: int, dw: float, dh: float) -> tuple[int, int, int, int, float] | None:
    """(left, top, right, bottom, confidence): the outermost pixels inside the room around (x, y), or None where no four walls stand."""
    h, w = wall.shape
    if not (0 <= x < w and 0 <= y < h):
        return None
    left, right = stops(wall, x, y), [w - 1 - s for s in stops(wall[:, ::-1], w - 1 - x, y)]
    top, bottom = stops(wall.T, y, x), [h - 1 - s for s in stops(wall.T[:, ::-1], h - 1 - y, x)]
    best = None
    want = np.log(dw / dh) if dw > 0 and dh > 0 else None
    for a, b, c, d in product(left, right, top, bottom):
        x0, x1, y0, y1 = a + 1, b - 1, c + 1, d - 1
        if x1 <= x0 or y1 <= y0:
            continue
        long = lambda n, m: n / max(1, m)
        cover = [long(K.rect_sum(sat, a, y0, a, y1), y1 - y0 + 1), long(K.rect_sum(sat, b, y0, b, y1), y1 - y0 + 1), long(K.rect_sum(sat, x0, c, x1, c), x1 - x0 + 1), long(K.rect_sum(sat, x0, d, x1, d), x1 - x0 + 1)]
        if min(cover) < LEAST_COVER:
            continue
        shape = np.log((x1 - x0 + 1) / (y1 - y0 + 1))
        off = 0.0 if want is None else min(abs(shape - want), abs(shape + want))
        score = float(np.mean(cover)) - 0.5 * min(1.0, off)
        key = (round(score, 9), -(x1 - x0) * (y1 - y0))
        if best is None or key > best[0]:
            best = (key, (x0, y0, x1, y1, max(0.0, min(0.98, score))))
    return best and best[1]


def grown(images: DataFrame, marks: DataFrame) -> DataFrame:
    """ROOMS of drawings, in original pixels. images: plan_id, width, height, data. marks: plan_id, label_id, name, x, y, dim_w, dim_h (feet)."""
    per = marks.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("label_id", "name", "x", "y", "dim_w", "dim_h"))).alias("marks"))  # a plan's labels are few

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROOMS.split(", ")]
        for f in frames:
            for row in f.itertuples():
                ink, scale, _ = K.binarize(np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1), detect.WORKING)
                wall, _ = detect.walls(ink)
                sat, out = K.summed(wall), []
                for m in row.marks:
                    room = grow(wall, sat, round(m["x"] * scale), round(m["y"] * scale), m["dim_w"], m["dim_h"])
                    if room:
                        x0, y0, x1, y1, sure = room
                        w, h = (x1 - x0 + 1) / scale, (y1 - y0 + 1) / scale
                        dw, dh = m["dim_w"], m["dim_h"]
                        if dw > 0 and dh > 0 and abs(np.log(w / h) + np.log(dw / dh)) < abs(np.log(w / h) - np.log(dw / dh)) and abs(np.log(w / h) - np.log(dw / dh)) > 0.05:
                            dw, dh = dh, dw
                        out.append((row.plan_id, m["label_id"], m["name"], x0 / scale, y0 / scale, (x1 + 1) / scale, (y1 + 1) / scale, sure, w / dw if dw > 0 else None, h / dh if dh > 0 else None, m["dim_w"], m["dim_h"]))
                yield pd.DataFrame(out, columns=names)

    # pictures are made by Python, so Spark takes them to be small: they are never the side that is held in memory or sorted
    return images.join(per.hint("shuffle_hash"), "plan_id").mapInPandas(run, ROOMS)


def outside_living(rooms: DataFrame, exterior: DataFrame | None) -> DataFrame:
    """rooms with outside: whether a label of what is no living area (plan_id, x, y) stands in the room."""
    if exterior is None:
        return rooms.withColumn("outside", F.lit(False))
    mark = exterior.select("plan_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    hit = rooms.select("plan_id", "label_id", "x0", "y0", "x1", "y1").join(R.large(mark), "plan_id").filter("_x BETWEEN x0 AND x1 AND _y BETWEEN y0 AND y1").select("plan_id", "label_id").distinct()
    return rooms.join(R.large(hit.withColumn("outside", F.lit(True))), ["plan_id", "label_id"], "left").withColumn("outside", F.coalesce("outside", F.lit(False)))


def auto_scale(images: DataFrame, marks: DataFrame, footprints: DataFrame, exterior: DataFrame | None = None) -> DataFrame:
    """The scale that all labelled rooms of a drawing agree on: consensus.select_scale over grown rooms. footprints: plan_id, area_px. exterior: plan_id, x, y of labels such as a garage's or a porch's."""
    return consensus.select_scale(outside_living(grown(images, marks), exterior), footprints)
