"""Product codes of vectors: each part of a vector becomes the number of the nearest entry of that part's codebook.

Codebooks are whole numbers. They are broadcast (parts x entries x components, all of them parameters or the length of one vector), Arrow batches give
all distances of a part by norms and one int64 product, and each task's sums of an entry's members are merged by a grouped shuffle, round by round.
So results are exact: no order of rows, partitions or retries changes them.

Rows without a vector, or with a null or non-finite component, are left out. Vectors shorter than the longest count as filled up with zeros, as does a length that the parts don't
divide. Rows that repeat are vectors of their own; a null key comes after all others. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._store import Workspace
from plumbline.llm._vectors import SUMS, Sums, distances, finite, matrix, moved, whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def whole_vectors(df: DataFrame, work: Workspace, key: str, vector: str, label: str, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(key, label, x) of the rows that are kept, as a table, and the length of x."""
    rows = df.filter(finite(vector)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    dims = max(1, -(-(most or 0) // parts)) * parts
    v = F.col("v") if least == dims else F.slice(F.concat("v", F.array_repeat(F.lit(0).cast(rows.schema["v"].dataType.elementType), dims)), 1, dims)
    return work.save(rows.select("key", "label", whole(v, scale, dims).alias("x")), "whole"), dims


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) the first nearest entry of each part, and its squared distance."""
    size = books.shape[2]
    at, far = [], []
    for p, book in enumerate(books):
        d = distances(x[:, p * size : (p + 1) * size], book)
        best = d.argmin(axis=1)
        at.append(best)
        far.append(d[np.arange(len(d)), best])
    return np.stack(at, axis=1), np.stack(far, axis=1)


def codebooks(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, components): codebooks that start as the parts of the vectors with the smallest keys, after all rounds. Fewer vectors than entries give fewer entries."""
    first = kept.orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    sc = kept.sparkSession.sparkContext
    for _ in range(rounds if len(first) else 0):
        held = sc.broadcast(books)

        def sums(batches, held=held):
            books = held.value
            k, size = books.shape[1:]
            total = Sums(parts * k, size)
            for batch in batches:
                x = matrix(batch.column(0), dims)
                at, far = nearest(x, books)
                for p in range(parts if len(x) else 0):
                    total.add(at[:, p] + p * k, x[:, p * size : (p + 1) * size], far[:, p])
            yield from total.rows()

        flat, _ = moved(books.reshape(-1, books.shape[2]), kept.select("x").mapInArrow(sums, SUMS))
        books = flat.reshape(books.shape)
        held.destroy()
    return books


def encoded(kept: DataFrame, dims: int, books: np.ndarray) -> DataFrame:
    """(key, label, code, error): two hex digits for each part, and the squared distance that the code loses."""
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            at, far = nearest(matrix(batch.column(2), dims), held.value)
            text, step = at.astype(np.uint8).tobytes().hex(), 2 * at.shape[1]
            code = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(far.sum(axis=1))], ["key", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.select("key", "label", "x").mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, work: Workspace, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each vector that is kept; other columns of df aren't read. label_error adds up the errors of equal labels, nulls together.

    A sum that leaves 64 bits is null.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 256 entries at most")
    kept, dims = whole_vectors(df, work, key, vector, label, parts, scale)
    books = codebooks(kept, dims, parts, entries, rounds)
    coded = work.save(encoded(kept, dims, books), "coded")
    # sums are made before the join, so it has a row a label on one side; a label that holds many rows is one that the join can split
    total = coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "vectorcodes"))


def _sql() -> str:
    """The rounds written out, one after the other."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
        lead AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept),
        book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN lead USING (r) WHERE e < 256)"""
    ]
    for k in range(5):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM
        (SELECT r, part.p, e, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM part JOIN book{k} b ON b.p = part.p) GROUP BY r, p)""")
        if k < 4:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN
        (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM part JOIN near{k} USING (r, p), range(1, 17) t(i) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return (
        "WITH "
        + ",\n".join(steps)
        + """,
        coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY r),
        told AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM book4)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), told"""
    )


OP11_SQL = _sql()
