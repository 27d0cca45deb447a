"""Queries whose rows go beyond what their SQL covers, against plain Python."""

import datetime as dt
import random
from collections import Counter

from plumbline.plans import QUERIES
from plumbline.plans import views as V

DATA = "/root/testdata/sf0.001"



def test_components_of_whole_rasters(spark, tmp_path):
    rng = random.Random(3)
    cells = {(u, h) for u in range(160) for h in range(40) if rng.random() < 0.55} | {(u, 45) for u in range(50, 150)}
    rows = [(u, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h), 1.0) for u, h in sorted(cells)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, QUERIES["ink_components"](spark, str(tmp_path)).select("plan_id", "root", "size").collect()))
    left, want = {(1000 * (u // 150) + h // 240, u % 150, h % 240) for u, h in cells}, []
    while left:
        todo, part = [left.pop()], []
        while todo:
            p, y, x = todo.pop()
            part.append(y * 1048576 + x)
            for n in ((p, y - 1, x), (p, y + 1, x), (p, y, x - 1), (p, y, x + 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        want.append((p, min(part), len(part)))
    assert got == sorted(want) and (0, 50 * 1048576 + 45, 100) in got


def test_labels_of_odd_and_even_lines(spark):
    told = {
        "BASEMENT": ("area", "basement"), "2nd  Floor": ("area", "2nd floor"), "GARAGE 20' x 9'": ("exterior", "garage"), "Main Level": ("area", "main level"), "Sun Deck": ("exterior", "sundeck"),
        "Lower lvl": ("area", "lower lvl"), "Swimming  Pool": ("exterior", "swimmingpool"), "floor 3": ("area", "floor 3"), "COVERED PORCH": ("exterior", "porch"), "garden level": ("area", "garden level"),
    }
    want = Counter()
    for r in V.distinct_items(spark, DATA).select("plan_id", "part", "disc").collect():
        text = V.LABELS[r.part % len(V.LABELS)]
        if text in told and r.disc <= 8:
            want[(r.plan_id, *told[text])] += 1
    got = {(r.plan_id, r.kind, r.keyword): r.n for r in QUERIES["labels_found"](spark, DATA).collect()}
    assert got == dict(want) and {k[1:] for k in got} == set(told.values())
