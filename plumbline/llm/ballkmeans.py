"""Ball k-means: clusters are balls, and a vector is compared only with the centroids that could take it.

A cluster's ball has its centroid and a radius. A centroid is a neighbour of the ball if it is no farther away than twice the radius; no other can be nearer
to any member. A member that is nearer to its own centroid than half the way to the nearest neighbour is in the stable core and stays. The others lie
in annuli, between half the ways to the neighbours in their order: in the m-th, only the first m neighbours are compared, exactly.

The radius of a moved ball is bounded by the old radius and the way that its centroid moved, so it needs no further pass. All numbers are whole, so a tie is a
tie, and it goes to the smaller number. Centroids, radii and neighbours are k or k x k numbers; vectors never move between partitions.

Vectors of another length, null ones, and such with a null or non-finite component are left out. Rows that repeat are vectors of their own. A null key comes last
in the choice of first centroids, equal keys follow their vectors. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._store import Workspace
from plumbline.llm._vectors import SUMS, Sums, distances, finite, matrix, moved, whole

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1


def neighbours(centre: np.ndarray, radius: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball the neighbour centroids, nearest first, and their squared distances."""
    apart = distances(centre, centre)
    out = []
    for i, r in enumerate(radius):
        near = np.array([j for j in np.argsort(apart[i], kind="stable") if j != i and int(apart[i, j]) <= 4 * r * r], np.int64)
        out.append((near, apart[i, near]))
    return out


def radii(before: np.ndarray, after: np.ndarray, far: np.ndarray) -> list[int]:
    """What each ball's radius is at most around its moved centroid. far: squared distances of the farthest members from the old one."""
    shift = ((after - before) ** 2).sum(axis=1)
    return [isqrt(int(f)) + 1 + isqrt(int(s)) + 1 for f, s in zip(far, shift)]


def reassign(x: np.ndarray, own: np.ndarray, centre: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector. own: the ball that it is in; near: neighbours()."""
    cluster, distance = own.copy(), ((x - centre[own]) ** 2).sum(axis=1)
    for i in np.unique(own):
        others, apart = near[i]
        rows = np.flatnonzero(own == i)
        annulus = np.searchsorted(apart, 4 * distance[rows], "right")  # 0: stable core
        for m in np.unique(annulus[annulus > 0]):
            at = rows[annulus == m]
            among = np.sort(np.append(others[:m], i))
            d = distances(x[at], centre[among])
            best = d.argmin(axis=1)
            cluster[at], distance[at] = among[best], d[np.arange(len(at)), best]
    return cluster, distance


def ball_kmeans(df: DataFrame, work: Workspace, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((key, x, cluster, distance) of each kept vector, final centroids). Other columns of df aren't read.

    The first centroids are the vectors with the smallest sha256 of 'seed:key'; fewer vectors than clusters give fewer clusters.
    """
    rows = df.filter(finite(vector) & (F.size(f"`{vector}`") == dims))
    kept = work.save(rows.select(F.col(f"`{key}`").alias("key"), whole(F.col(f"`{vector}`"), scale, dims).alias("x")), "whole")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).asc_nulls_last(), "x").limit(clusters).select("x").collect()
    centre = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    kind = kept.schema["key"].dataType.simpleString()
    shape = f"key {kind}, x array<int>, cluster int, distance long"

    def assigned(state: DataFrame, centre: np.ndarray, near: list | None) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = matrix(batch.column(1), dims)
                if near is None:
                    d = distances(x, centre)
                    at = d.argmin(axis=1)
                    far = d[np.arange(len(d)), at]
                else:
                    at, far = reassign(x, batch.column(2).to_numpy().astype(np.int64), centre, near)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(far)], ["key", "x", "cluster", "distance"])

        return state.mapInArrow(run, shape)

    def sums(batches):
        total = Sums(len(centre), dims)
        for batch in batches:
            if batch.num_rows:
                total.add(batch.column(1).to_numpy().astype(np.int64), matrix(batch.column(0), dims), batch.column(2).to_numpy())
        yield from total.rows()

    if not first:
        return kept.selectExpr("key", "x", "cast(null as int) cluster", "cast(null as long) distance"), centre
    state = work.save(assigned(kept, centre, None), "assigned0")
    work.drop("whole")
    for k in range(rounds):
        after, far = moved(centre, state.select("x", "cluster", "distance").mapInArrow(sums, SUMS))
        near = neighbours(after, radii(centre, after, far))
        centre = after
        state = work.save(assigned(state, centre, near), f"assigned{k + 1}")
        work.drop(f"assigned{k}")
    return state, centre


def clustered(df: DataFrame, work: Workspace, key: str = "vec_id", vector: str = "embedding", **given) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector; a sum that leaves 64 bits is null."""
    state, centre = ball_kmeans(df, work, key, vector, **given)
    spark = df.sparkSession
    total = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect() if r.cluster is not None}
    fits = lambda n: n if n < 2**63 else None
    told = [(c, fits(n), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centre[c].tolist())).encode()).hexdigest()) for c, n in total.items()]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a cluster: safe to broadcast
    return state.join(F.broadcast(each), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "ballkmeans"))


def _sql() -> str:
    """The rounds written out; every vector is compared with every centroid."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        book0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS e, x AS c FROM kept QUALIFY e < 16)"""
    ]
    for k in range(4):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM
        (SELECT r, e, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM kept, book{k}) GROUP BY r)""")
        if k < 3:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN
        (SELECT e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT e, i, sum(x[i]) AS s, count(*) AS n FROM kept JOIN near{k} USING (r), range(1, 65) t(i) GROUP BY e, i) GROUP BY e) m ON m.e = b.e)""")
    return (
        "WITH "
        + ",\n".join(steps)
        + """
        SELECT vec_id, e::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY e)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM kept JOIN near3 USING (r) JOIN book3 USING (e)"""
    )


OP13_SQL = _sql()
