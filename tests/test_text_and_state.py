"""The reader of printed dimensions, project files, and streams against their batch twins."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import checksums, dimtext, geom, units
from plumbline.sources import projects
from plumbline.streaming import documents, history


@pytest.mark.parametrize("text,width,height,kind", [
    ("12'5\" x 10'0\"", 12 + 5 / 12, 10, "inches"),
    ("12’ 5” × 10′ 3″", 12 + 5 / 12, 10.25, "inches"),
    ("12 ft 5 in x 10 ft 3 in", 12 + 5 / 12, 10.25, "inches"),
    ("12.5 x 10.25", 12.5, 10.25, "decimal"),
    ("3.5 m x 4 m", 3.5 * 3.28084, 4 * 3.28084, "meters"),
    ("3.5 m x 4", 3.5 * 3.28084, 4 * 3.28084, "meters"),
    ("KITCHEN 12' x 10'", 12, 10, "inches"),
    ("12'-5\" by 10'-3\"", 12 + 5 / 12, 10.25, "inches"),
    ("11-4 x 10-6", 11 + 4 / 12, 10.5, "inches"),
    ("105 x 8.3", 10.5, 8.3, "decimal"),
    ("96 x 11'4\"", 9.5, 11 + 4 / 12, "inches"),
    ("12'5\" 10'3\"", 12 + 5 / 12, 10.25, "inches"),
    ("l2'5\" x 1O'0\"", 12 + 5 / 12, 10, "inches"),
])
def test_readings(text, width, height, kind):
    p = dimtext.parse_line(text)
    assert p and p.format == kind and math.isclose(p.width, width) and math.isclose(p.height, height), p


@pytest.mark.parametrize("text", [None, "", "BEDROOM", "5", "2 x 99", "1" * 13 + " x 2", "x" * 90, "12 x", "0.5 x 0.5"])
def test_what_is_no_dimension(text):
    assert dimtext.parse_line(text) is None


def test_normalized_text_is_the_same_in_spark(spark):
    texts = ["12’ 5” × 10", "l2 by 1O'", "s' x 4", "12,5 x 3", "a12ft3in", "12'-5\" + 3", "3b4 z 5s6", "  X  x x ", "3 | 4!", "10 · 5;", "ﬁ12'' * 3"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dimtext.normalized(F.col("t"))).collect()]
    assert got == [dimtext.normalize(t) for t in texts]


def test_parse_lines_in_spark(spark):
    rows = [("12' x 10'",), (None,), ("none",), ("12' x 10'",)]
    got = spark.createDataFrame(rows, "t string").select(dimtext.parse_lines("t").alias("p")).select("p.width", "p.format").collect()
    assert [tuple(r) for r in got] == [(12.0, "inches"), (None, None), (None, None), (12.0, "inches")]


def test_units(spark):
    one = spark.range(1)
    cell = lambda c: one.select(c.alias("v")).first().v
    lit = F.lit
    assert tuple(cell(units.feet_inches(lit(11.99)))) == (12, 0) and cell(units.format_length(lit(12.4), lit("inches"), lit(None).cast("string"))) == "12'5\""
    assert cell(units.format_area(lit(1234567.5), lit("decimal")))["value"] == "1,234,568" and cell(units.format_area(lit(5.0), lit("metric")))["value"] == "0.46"
    assert tuple(cell(units.format_area_number(lit(1234.5), lit("metric")))) == ("1,234.50", "m²") and tuple(cell(units.format_area_number(lit(1234.0), lit("decimal")))) == ("1,234", "ft²")
    assert cell(units.dimension_input(lit(0.0), lit("inches"))) == "" and cell(units.fixed(lit(-0.04), 1)) == "0.0" and cell(units.area_shown(lit(-3.0), lit("decimal"))) == 0


def test_geometry(spark):
    def ring(*p):
        return F.array(*[geom.point(F.lit(x), F.lit(y)) for x, y in p])

    cell = lambda c: spark.range(1).select(c.alias("v")).first().v
    square, bow = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 0), (4, 4), (4, 0), (0, 4))
    assert cell(geom.signed_area(square)) == 16 and cell(geom.signed_area(ring((0, 0), (1, 1)))) == 0
    assert cell(geom.self_intersects(bow)) and not cell(geom.self_intersects(square)) and cell(geom.self_intersects(ring((0, 0), (4, 0), (0, 0.000001))))
    assert tuple(cell(geom.centroid(ring((1, 1), (3, 3))))) == (2, 2) and tuple(cell(geom.centroid(F.array().cast("array<struct<x:double,y:double>>")))) == (0, 0)
    assert cell(geom.in_ring(geom.point(F.lit(1), F.lit(1)), square)) and not cell(geom.in_ring(geom.point(F.lit(5), F.lit(1)), square))
    assert not cell(geom.in_area(geom.point(F.lit(1), F.lit(1)), square, F.array(ring((0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2)))))
    assert cell(geom.winding(square)) == "CW" and cell(geom.winding(F.reverse(square))) == "CCW" and cell(geom.winding(ring((0, 0), (1, 1), (2, 2)))) == "degenerate"
    assert cell(geom.segment_distance(geom.point(F.lit(2), F.lit(3)), geom.point(F.lit(0), F.lit(0)), geom.point(F.lit(4), F.lit(0)))) == 3
    assert cell(geom.edge_class(geom.point(F.lit(0), F.lit(0)), geom.point(F.lit(10), F.lit(1)))) == "h"


def test_checksums(spark):
    import zlib

    texts = ["", "abc", "é😀", "a" * 9000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", checksums.image_key(F.col("t")).alias("k"), checksums.adler32(F.encode("t", "UTF-8")).alias("a"), checksums.crc32(F.encode("t", "UTF-8")).alias("c")).collect():
        u = r.t.encode("utf-16-be")
        units_ = [int.from_bytes(u[i : i + 2], "big") for i in range(0, len(u), 2)]
        h = 0x811C9DC5
        for x in units_[:8192] + [ord(c) for c in f"|{len(units_)}"]:
            h = (h ^ x) * 0x01000193 & 0xFFFFFFFF
        assert r.k == (f"{h:X}".lower() if r.t else None) and r.a == zlib.adler32(r.t.encode()) and r.c == zlib.crc32(r.t.encode())


def test_projects(spark):
    good = '{"metadata":{"version":1,"title":"a"},"settings":{"scalar":0.5},"imageRef":"k","images":{"k":"data:x"},"traces":[{"id":"t","vertices":[{"x":1,"y":2}]}]}'
    r = projects.parse(spark.createDataFrame([(good,)], "json string")).first()
    assert r.image == "data:x" and tuple(r.scale) == (0.5, 0.5) and r.p.traces[0].vertices[0].x == 1
    for bad in ('{"metadata":{"version":2}}', "{nonsense", '{"traces": 5}'):
        with pytest.raises(Exception):
            projects.parse(spark.createDataFrame([(bad,)], "json string")).collect()
    name = spark.range(1).select(projects.file_name(F.lit('a/b: "c"  '), F.lit(dt.date(2024, 2, 9)))).first()[0]
    assert name == "a b c 2024-02-09.json"


def test_images_no_record_names(spark):
    drafts = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "doc_id long, image string")
    records, images = projects.split_drafts(drafts)
    assert images.count() == 2
    back = {r.doc_id: (r.status, r.image) for r in projects.join_drafts(records, images.filter("image = 'x'")).collect()}
    assert back == {1: ("ok", "x"), 2: ("ok", "x"), 3: ("empty", None), 4: ("no-image", None)}
    assert [r.image for r in projects.unreferenced(images, records.filter("doc_id < 4")).collect()] == ["y"]


def test_history_stream_is_the_batch(spark, tmp_path):
    kinds = ["save", "save", "undo", "cancel", "redo", "save", "cancel", "undo", "undo", "undo", "redo"]
    rows = [(d, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, kinds[(i * (d + 3)) % len(kinds)], i) for d in range(4) for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id bigint, ts timestamp, seq bigint, command string, state bigint")
    batch = {r.doc_id: tuple(r) for r in history.fold(df).collect()}
    for k in range(3):
        df.filter(F.floor(F.col("seq") / 50) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}

    def keep(b, _):
        got.update({r.doc_id: tuple(r) for r in b.collect()})

    q = history.stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # files may come in any order; with one file the fold and the stream are the same
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.readStream.schema(df.schema).parquet(str(tmp_path / "one"))
    got.clear()
    q = history.stream(one).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == batch


def test_history_rules():
    s = (0, (), (), (), False, 0)
    for i in range(1, 61):
        s = history.apply(s, "save", i)
    assert len(s[1]) == 50 and s[1][0] == 10
    s = history.apply(history.apply(s, "undo", 0), "undo", 0)
    assert s[0] == 58 and s[2] == (60, 59)
    t = history.apply(history.apply(s, "save", 99), "cancel", 0)
    assert (t[0], t[2]) == (58, (60, 59)) and history.apply(t, "cancel", 0)[0] == 58


def test_autosaves_on_a_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m), m, "edit", m) for m in (0, 10, 25, 90)] + [(1, t0 + dt.timedelta(minutes=40), 40, "camera", 40), (2, t0 + dt.timedelta(minutes=500), 1, "edit", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, ts timestamp, seq bigint, kind string, state bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = documents.autosaves(source).writeStream.outputMode("append").format("memory").queryName("saves").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.doc_id, r.n, r.state) for r in spark.table("saves").collect())
    want = sorted((r.doc_id, r.n, r.state) for r in documents.autosaves(df).collect())
    assert want == [(1, 1, 90), (1, 3, 25), (2, 1, 7)] and set(got) <= set(want) and (1, 3, 25) in got


def test_workspaces(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    i = spark.createDataFrame([("a", "2024-01-09 23:00:00", [1]), ("b", "2024-01-09 23:59:00", [2]), ("c", "2024-01-09 12:00:00", [3]), ("d", "2024-01-01 00:00:00", [4])], "workspace string, saved_at string, docs array<bigint>").withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    live = spark.createDataFrame([("a",)], "workspace string")
    assert [r.workspace for r in documents.adopted(i, live, now).collect()] == ["c"]
    assert sorted(r.doc_id for r in documents.orphans(spark.createDataFrame([(k,) for k in (1, 3, 4, 9)], "doc_id bigint"), i, now).collect()) == [4, 9]
    reqs = spark.createDataFrame([("k", 2, 1), ("k", 1, 5), ("m", 1, 1)], "image string, ts bigint, seq bigint")
    assert sorted(map(tuple, documents.scans_once(reqs).collect())) == [("k", 1, 5), ("m", 1, 1)]
