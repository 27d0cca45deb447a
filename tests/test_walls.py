"""Walls in run tables, and their kernels, on small drawings."""

import numpy as np

from plumbline.functions import geom, working
from plumbline.operators import kernels as K
from plumbline.operators import walls
from plumbline.operators.grouped import apply_sorted


def test_bridges_with_a_probe():
    m = np.zeros((60, 80), bool)
    m[30:33, :30] = m[30:33, 42:] = True
    assert K.bridge(m, 16, 8)[31].all() and K.bridge(m, 16, 8, 25)[31].all()
    m[10:30, 27:30] = m[10:30, 42:45] = True  # walls go off to one side at both ends
    assert K.bridge(m, 16, 8)[31].all() and not K.bridge(m, 16, 8, 25)[31].all()


def test_runs_beside_a_pixel():
    m = np.random.default_rng(3).random((15, 9)) < 0.6
    up, down = K._beside(m)
    for y in range(15):
        for x in range(9):
            a = next((d for d in range(1, 16) if y - d < 0 or not m[y - d, x]), 0) - 1
            b = next((d for d in range(1, 16) if y + d > 14 or not m[y + d, x]), 0) - 1
            assert (up[y, x], down[y, x]) == (a, b)


def test_walls_at_full_length():
    m = np.zeros((40, 60), bool)
    m[10:13, 5:20] = m[11:14, 30:50] = m[5:35, 2:5] = True
    full, longest = K.spans(m, 12, 8, 12)
    assert full[11, 5:50].all() and longest == 10 and not K.spans(m, 12, 8, 9)[0][11, 20:30].any()


def test_reading_order(spark):
    rows = [(1, 1, 200.0, 0.0, 300.0, 100.0), (1, 2, 0.0, 20.0, 100.0, 110.0), (1, 3, 50.0, 90.0, 99.0, 190.0), (1, 4, 0.0, 150.0, 40.0, 260.0), (2, 9, 0.0, 0.0, 5.0, 5.0)]
    f = spark.createDataFrame(rows, "plan_id long, floor long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.plan_id, r.floor): r.place for r in walls.reading_order(f).collect()} == {(1, 2): 0, (1, 1): 1, (1, 4): 2, (1, 3): 3, (2, 9): 0}


def test_insets_of_a_skewed_ring(spark):
    import pyspark.sql.functions as F

    ring = F.array(*[geom.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (30, 10), (20, 40), (-10, 30))])
    row = spark.range(1).select(geom.ring_area(geom.moved_in(ring, F.array(*[F.lit(2.0)] * 4))).alias("a"), geom.ring_area(geom.moved_in(F.reverse(ring), F.array(*[F.lit(2.0)] * 4))).alias("b")).first()
    side = np.hypot(30, 10)
    assert np.isclose(row.a, (side - 4) ** 2) and np.isclose(row.b, (side - 4) ** 2)


def test_retries_and_attempts(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, 0.6, 1.0, 2), (1, 1, 0.9, 1.0, 1), (1, 2, 0.7, 1.0, 2), (1, 3, 0.7005, 1.0, 3), (2, 0, 0.5, 0.5, 0)]
    a = spark.createDataFrame(rows, "plan_id long, round long, confidence double, factor double, held long")
    assert {r.plan_id: (r.round, r.effective) for r in walls.best_attempts(a).collect()} == {1: (2, 0.7), 2: (0, 0.25)}
    got = spark.range(1).select(*[walls.should_retry(F.lit(c), F.lit(m), F.lit(d)).alias(n) for n, c, m, d in (("a", 0.9, 0, False), ("b", 0.9, 1, False), ("c", 0.7, 0, False), ("d", 0.1, 3, True))]).first()
    assert tuple(got) == (False, True, True, False)


def test_groups_over_many_batches(spark):
    import pandas as pd

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 7), (4, 1), (5, 14)) for i in range(n)], "k long, i long")
        out = apply_sorted(df, ["k"], ["i"], lambda g: pd.DataFrame({"k": [g.k.iloc[0]], "n": [len(g)], "s": [int(g.i.sum())]}), "k long, n long, s long")
        assert {r.k: (r.n, r.s) for r in out.collect()} == {1: (50, 1225), 2: (3, 3), 3: (7, 21), 4: (1, 0), 5: (14, 91)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_names_and_samples(spark):
    from pyspark.sql import functions as F

    rows = [(i, n) for i, n in enumerate(["A", "A", "A (2)", "A", "A (4)", "A", None, " "])]
    out = working.unique_names(spark.createDataFrame(rows, "k long, name string").withColumn("p", F.lit(1)), ["p"], "name", "k")
    assert {r.k: r.unique_name for r in out.collect()} == {0: "A", 1: "A (3)", 2: "A (2)", 3: "A (5)", 4: "A (4)", 5: "A (6)", 6: "Sketch", 7: "Sketch (2)"}
    rooms = F.array(*[F.struct(F.lit(a).cast("double").alias("left"), F.lit(0.0).alias("top"), F.lit(a + 10).cast("double").alias("right"), F.lit(10.0).alias("bottom"), F.lit(s).alias("sx"), F.lit(s).alias("sy")) for a, s in ((0, 1.0), (100, 2.0))])
    got = spark.range(1).select(working.other_samples(rooms, F.lit(20), F.lit(20), F.lit(0), F.lit(0)).alias("s")).first().s
    assert got == [2.0, 2.0]
