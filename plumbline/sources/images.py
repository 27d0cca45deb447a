"""Drawings as rows: image files, a PNG writer and reader for grey images, and drawings made from outlines."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_PDF_BYTES, MAX_SIDE = 20 << 20, 60 << 20, 4000  # fixed values


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content) of files small enough to read; kind is pdf or image."""
    f = spark.read.format("binaryFile").load(path)
    kind = F.when(F.lower("path").endswith(".pdf"), "pdf").when(F.lower("path").rlike(r"\.(png|jpe?g|gif|webp|bmp)$"), "image")
    return f.select("path", kind.alias("kind"), "length", "content").filter((F.col("kind") == "image") & (F.col("length") <= MAX_BYTES) | (F.col("kind") == "pdf") & (F.col("length") <= MAX_PDF_BYTES))


def png(g: np.ndarray) -> bytes:
    """A grey PNG whose data is stored, not compressed: quick to write where another process reads it at once."""
    h, w = g.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = g
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 0)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """A grey image of png() again; rows may have any of PNG's filters 0 to 2."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body = 8, b""
    w = h = 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            w, h, depth, color = struct.unpack_from(">IIBB", part)
            if (depth, color) != (8, 0):
                raise ValueError("8-bit grey only")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w + 1)
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:]
        out[y] = line if f == 0 else np.cumsum(line, dtype=np.uint8) if f == 1 else line + (out[y - 1] if y else 0)
    return out


def fit_side(width: int, height: int, most: int = MAX_SIDE) -> tuple[int, int]:
    """The size of an image whose longer side is most at most."""
    k = min(1.0, most / max(width, height, 1))
    return max(1, round(width * k)), max(1, round(height * k))


def drawing(rings: list[np.ndarray], width: int, height: int, thick: int) -> np.ndarray:
    """RGBA of a white page with axis-parallel walls of a thickness, their centre lines along the rings."""
    page = np.full((height, width, 4), 255, np.uint8)
    half = thick // 2
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
            x0, x1, y0, y1 = int(min(ax, bx)) - half, int(max(ax, bx)) + half, int(min(ay, by)) - half, int(max(ay, by)) + half
            page[max(0, y0) : y1 + 1, max(0, x0) : x1 + 1, :3] = 0
    return page


def drawn(outlines: DataFrame, width: int, height: int, thick: int) -> DataFrame:
    """images of outlines (plan_id, ring): each on a page of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                ring = np.array([(p["x"], p["y"]) for p in row.ring])
                yield pd.DataFrame({"plan_id": [row.plan_id], "width": [width], "height": [height], "data": [drawing([ring], width, height, thick).tobytes()]})

    return outlines.select("plan_id", "ring").mapInPandas(run, "plan_id bigint, width int, height int, data binary")
