"""Open drawings: what becomes of commands and of results that come late; the stream gives what the batch gives."""

import json

from pyspark.sql import functions as F

from plumbline.streaming import documents, sessions

LOG = "session long, seq long, kind string, doc long, arg long"


def run(spark, rows):
    out = sessions.replay(spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], LOG)).orderBy("seq").collect()
    return out


def test_a_result_waits_for_its_drawing(spark):
    out = run(spark, [("image", None, 7), ("begin", None, None), ("open", None, None), ("deliver", None, 2), ("settle", None, 2), ("switch", 0, None), ("deliver", None, 2)])
    assert [r.result for r in out] == ["set", "begun", "opened", "routed", "settled", "switched", "applied"]
    assert [r.waiting for r in out] == [0, 0, 0, 1, 1, 0, 0] and [r.in_flight for r in out] == [0, 1, 1, 1, 0, 0, 0] and out[5].value == 4 and out[6].value == 7


def test_stale_refused_and_dropped(spark):
    out = run(spark, [("image", None, 1), ("begin", None, None), ("image", None, 2), ("deliver", None, 2), ("begin", None, None), ("open", None, None), ("calibrate", None, 5), ("close", 0, None), ("deliver", None, 5)])
    assert [r.result for r in out][3:] == ["stale", "begun", "opened", "refused", "closed", "dropped"] and out[7].in_flight == 0


def test_tabs(spark):
    out = run(spark, [*[("open", None, None)] * 6, ("move", 3, 0), ("move", 3, 0), ("switch", 3, None), ("close", 3, None), ("close", 99, None), ("switch", 0, None), ("move", 0, 50)])
    assert [r.result for r in out] == ["opened"] * 5 + ["full", "moved", "same", "switched", "closed", "none", "same", "moved"]
    assert out[9].active == 0 and out[9].tabs == [0, 1, 2, 4, 5] and out[12].tabs == [1, 2, 4, 5, 0]
    last = run(spark, [("close", 0, None), ("close", -1, None)])
    assert [(r.active, r.tabs) for r in last] == [(-1, [-1]), (-2, [-2])]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = []
    for s in range(3):
        opened = [0]
        for q in range(1, 60):
            kind = rng.choice(["open", "switch", "close", "move", "image", "begin", "begin", "deliver", "deliver", "calibrate", "settle"])
            if kind == "open":
                opened.append(q)
            rows.append((s, q, kind, rng.choice(opened), rng.randint(0, q)))
    folder = str(tmp_path / "log")
    for lo in (0, 20, 40):
        spark.createDataFrame([r for r in rows if lo < r[1] <= lo + 20], LOG).coalesce(1).write.mode("append").json(folder)
    q = sessions.stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(folder)).writeStream.format("memory").queryName("tabs").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    key = lambda df: sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    assert key(spark.table("tabs")) == key(sessions.replay(spark.createDataFrame(rows, LOG)))


def test_refused_in_the_batch_form(spark):
    rows = [(1, 1, "show", 1, 5, None, True), (1, 2, "show", 2, 6, None, True), (1, 3, "deliver", 1, 5, 0, True), (1, 4, "deliver", 1, 5, 0, False)]
    log = spark.createDataFrame(rows, "session long, seq long, kind string, doc long, image long, begun long, replayable boolean")
    assert [r.verdict for r in documents.verdicts(log).orderBy("seq").collect()] == ["routed", "refused"]


def test_roll_call(spark):
    beats = spark.createDataFrame([(1, "2024-01-01 00:00:00.1"), (2, "2024-01-01 00:00:00.2"), (1, "2024-01-01 00:00:00.3")], "session long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.sessions for r in sessions.alive(beats).orderBy("begin").collect()] == [[1, 2], [1]]
