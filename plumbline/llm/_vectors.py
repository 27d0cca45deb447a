"""Vectors as whole numbers, and exact sums of them.

Components are floored after scaling and kept within bound(): so far apart that no squared distance, nor four times one, leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = "g long, pos int, n long, s long, far long"


def bound(dims: int) -> int:
    """The largest size of a component for which 4 x a squared distance of dims components fits 63 bits."""
    return isqrt((2**63 - 1) // max(1, dims)) // 4


def finite(vector: str) -> Column:
    """True where the vector is there and each of its components is a finite number."""
    v = F.col(vector)
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of each component as double; what is beyond bound() counts as that bound."""
    most = float(bound(dims))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * scale))).cast("int"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) int64 of a list column whose lists all have dims members."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows of x, rows of c) squared distances: norms and one product of int64 matrices."""
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)


class Sums:
    """Counts, componentwise sums and the greatest distance of the vectors of each group, for one task."""

    def __init__(self, groups: int, dims: int):
        self.n, self.s, self.far = np.zeros(groups, np.int64), np.zeros((groups, dims), np.int64), np.zeros(groups, np.int64)

    def add(self, group: np.ndarray, x: np.ndarray, distance: np.ndarray) -> None:
        order = np.argsort(group, kind="stable")
        at = np.flatnonzero(np.diff(group[order], prepend=-1))
        found = group[order[at]]
        self.n[found] += np.diff(np.append(at, len(order)))
        self.s[found] += np.add.reduceat(x[order], at)
        self.far[found] = np.maximum(self.far[found], np.maximum.reduceat(distance[order], at))

    def rows(self) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(self.n)
        dims = self.s.shape[1]
        if len(used):
            column = [used.repeat(dims), np.tile(np.arange(dims, dtype=np.int32), len(used)), self.n[used].repeat(dims), self.s[used].ravel(), self.far[used].repeat(dims)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in column], ["g", "pos", "n", "s", "far"])


def merged(sums: DataFrame) -> DataFrame:
    """(g, pos, n, s, far) of all tasks; s as decimal, which no number of rows overflows."""
    return sums.groupBy("g", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("far").alias("far"))


def moved(before: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(means, radii): floor(sum / count) of each group, where it has members, and the squared distance of its farthest one. As many rows come to the driver as `before` has numbers."""
    after, far = before.copy(), np.zeros(len(before), np.int64)
    for g, pos, n, s, f in merged(sums).collect():
        after[g, pos], far[g] = int(s) // n, f
    return after, far
