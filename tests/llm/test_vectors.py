"""Vector codes and ball k-means against plain versions in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm._store import Workspace
from plumbline.llm._vectors import bound, distances
from plumbline.llm.ballkmeans import clustered, neighbours, radii, reassign
from plumbline.llm.vectorcodes import vector_codes

SHAPE = "vec_id long, embedding array<float>, label int, code string, cluster string"


def rows(n, dims, seed, ties=False):
    r = random.Random(seed)
    draw = (lambda: r.randint(-1, 1) / 2) if ties else (lambda: r.gauss(0, 0.3))
    return [(i, [float(np.float32(draw())) for _ in range(dims)], r.choice([0, 0, 0, 1, None]), "x", "y") for i in range(n)]


def dist(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def centre(members, old):
    return [sum(m[i] for m in members) // len(members) for i in range(len(old))] if members else old


def plain_codes(data, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]] for p in range(parts)]
    assign = lambda: [[min(range(len(b)), key=lambda e: (dist(cut(v, p), b[e]), e)) for p, b in enumerate(books)] for _, v, _ in kept]
    for _ in range(rounds):
        at = assign()
        books = [[centre([cut(v, p) for (_, v, _), a in zip(kept, at) if a[p] == e], c) for e, c in enumerate(b)] for p, b in enumerate(books)]
    at = assign()
    error = [sum(dist(cut(v, p), books[p][a[p]]) for p in range(parts)) for (_, v, _), a in zip(kept, at)]
    told = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in a), err, sum(x for (_, _, y), x in zip(kept, error) if y == label), told) for (i, _, label), a, err in zip(kept, at, error)]


def plain_clusters(data, clusters, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda k: (k[0] is None, hashlib.sha256(f"{seed}:{k[0]}".encode()).hexdigest(), k[1])
    book = [v for _, v in sorted(kept, key=order)[:clusters]]
    assign = lambda: [min(range(len(book)), key=lambda e: (dist(v, book[e]), e)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        book = [centre([v for (_, v), a in zip(kept, at) if a == e], c) for e, c in enumerate(book)]
    at = assign()
    far = [dist(v, book[a]) for (_, v), a in zip(kept, at)]
    return [(i, a, d, sum(x for x, b in zip(far, at) if b == a), sum(far), hashlib.sha256(",".join(map(str, book[a])).encode()).hexdigest()) for (i, _), a, d in zip(kept, at, far)]


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("ties", [False, True])
def test_codes_equal_the_plain_ones(spark, ties):
    data = [*rows(90, 16, 3, ties), (5, None, 1, "", ""), (6, [float("nan")] * 16, 1, "", ""), (7, [float("inf")] + [0.0] * 15, 1, "", ""), (8, [None] * 16, 1, "", ""), (None, [0.25] * 16, None, "", ""), (3, [0.5] * 16, 0, "", ""), (3, [0.5] * 16, 0, "", "")]
    df = spark.createDataFrame(data, SHAPE).repartition(3)
    same(vector_codes(df, Workspace(spark, "t"), entries=20).collect(), plain_codes(data, 4, 20, 4, 1024))


@pytest.mark.parametrize("ties", [False, True])
def test_clusters_equal_the_plain_ones(spark, ties):
    data = [*rows(300, 4, 5, ties), (5, None, 1, "", ""), (6, [float("nan")] * 4, 1, "", ""), (7, [0.0] * 3, 1, "", ""), (8, [0.0, None, 0.0, 0.0], 1, "", ""), (None, [0.25] * 4, 0, "", ""), (9, [0.5] * 4, 0, "", ""), (9, [0.5] * 4, 0, "", "")]
    df = spark.createDataFrame(data, SHAPE).repartition(3)
    same(clustered(df, Workspace(spark, "t"), dims=4).collect(), plain_clusters(data, 16, 3, 4, 64, 1))


def test_no_rows_few_rows_and_huge_components(spark):
    none = spark.createDataFrame([], SHAPE)
    assert vector_codes(none, Workspace(spark, "t")).collect() == [] and clustered(none, Workspace(spark, "t")).collect() == []
    one = spark.createDataFrame([(1, [1e38, -1e38] * 32, 0, "", "")], SHAPE)
    got = vector_codes(one, Workspace(spark, "t")).first()
    assert (got.code, got.error, got.label_error) == ("00000000", 0, 0)
    two = spark.createDataFrame([(1, [1e38] * 64, 0, "", ""), (2, [-1e38] * 64, 0, "", "")], SHAPE)
    assert [r.distance for r in clustered(two, Workspace(spark, "t")).collect()] == [0, 0]
    assert clustered(two, Workspace(spark, "t"), clusters=1, rounds=0).agg({"distance": "max"}).first()[0] == 64 * (2 * bound(64)) ** 2


def test_short_vectors_are_filled_up_with_zeros(spark):
    mixed = spark.createDataFrame([(1, [0.5, 0.5, 0.5], 0, "", ""), (2, [0.5], 0, "", ""), (3, [], 0, "", "")], SHAPE)
    full = spark.createDataFrame([(1, [0.5, 0.5, 0.5, 0.0], 0, "", ""), (2, [0.5, 0.0, 0.0, 0.0], 0, "", ""), (3, [0.0] * 4, 0, "", "")], SHAPE)
    same(vector_codes(mixed, Workspace(spark, "t")).collect(), vector_codes(full, Workspace(spark, "t")).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 9), st.integers(1, 4), st.integers(1, 40))
def test_what_a_ball_leaves_out_could_not_have_won(seed, k, dims, spread):
    r = np.random.default_rng(seed)
    before = r.integers(-spread, spread + 1, (k, dims))
    x = r.integers(-spread, spread + 1, (80, dims))
    d = distances(x, before)
    own = d.argmin(axis=1)
    far = np.array([d[own == i, i].max() if (own == i).any() else 0 for i in range(k)])
    after = before + r.integers(-2, 3, (k, dims))
    near = neighbours(after, radii(before, after, far))
    cluster, distance = reassign(x, own, after, near)
    best = distances(x, after)
    assert (cluster == best.argmin(axis=1)).all() and (distance == best.min(axis=1)).all()
