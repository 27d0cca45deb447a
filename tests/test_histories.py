"""Histories that are put aside and taken up again."""

import datetime as dt
import random

from pyspark.sql import functions as F

from plumbline.sources.tables import Workspace
from plumbline.streaming import history

SHAPE = "doc_id bigint, ts timestamp, seq bigint, command string, state bigint"


def log(spark, docs=5, n=160):
    r = random.Random(3)
    rows = [(d, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, r.choice(("save", "save", "save", "undo", "redo", "cancel")), i) for d in range(docs) for i in range(n)]
    return rows, spark.createDataFrame(rows, SHAPE).repartition(3)


def told(df):
    return {r.doc_id: (r.now, tuple(r.undo), tuple(r.redo), tuple(r.held), r.fresh, r.n) for r in df.collect()}


def test_stop_restore_continue_equals_one_run(spark):
    rows, df = log(spark)
    want = {}
    for d, _, _, command, value in rows:
        want[d] = history.apply(want.get(d, history.EMPTY), command, value)
    assert told(history.states(df)) == want
    work, kept = Workspace(spark, "t"), None
    for k, (lo, hi) in enumerate(((0, 1), (1, 40), (40, 41), (41, 160))):  # cuts also between a save and the cancel that would take it back
        part = df.filter(F.col("seq").between(lo, hi - 1))
        record = work.save(history.records(history.states(part, kept)), f"record{k}")
        kept = history.adopted(record)
    assert told(kept) == want
    pool = {r.doc_id: r.pool for r in record.collect()}
    assert all(pool[d] == sorted({s[0], *s[1], *s[2], *s[3]}) for d, s in want.items())


def test_documents_that_are_only_kept_or_only_new(spark):
    rows, df = log(spark, 3, 20)
    first = history.states(df.filter("doc_id < 2"))
    got = told(history.states(df.filter("doc_id > 0"), first))
    alone = told(history.states(df))
    assert got[0] == alone[0] and got[2] == alone[2] and got[1][5] == 40
    none = spark.createDataFrame([], SHAPE)
    assert told(history.states(none, first)) == told(first) and told(history.states(none)) == {}


def test_records_that_cannot_be_read_begin_anew(spark):
    shape = "doc_id bigint, version int, now bigint, undo array<bigint>, redo array<bigint>, held array<bigint>, fresh boolean, n bigint, pool array<bigint>"
    rows = [(1, 1, 5, [1, 2], None, None, None, None, []), (2, 9, 5, [1], [], [], False, 1, []), (3, 1, 5, None, [], [], False, 1, []), (4, 1, 7, list(range(80)), [], [], True, 80, [])]
    got = told(history.adopted(spark.createDataFrame(rows, shape)))
    assert got == {1: (5, (1, 2), (), (), False, 0), 4: (7, tuple(range(30, 80)), (), (), True, 80)}


def test_export_and_clear(spark):
    shape = "doc_id bigint, now bigint, undo array<bigint>, redo array<bigint>, held array<bigint>, fresh boolean, n bigint"
    state = spark.createDataFrame([(1, 5, [1, 2], [9], [4], True, 3), (2, 6, [1], [], [], False, 1)], shape)
    assert [tuple(r) for r in history.exported(state).orderBy("doc_id").collect()] == [(1, [1, 2], [9], [1, 2, 9]), (2, [1], [], [1])]
    gone = spark.createDataFrame([(1,), (1,)], "doc_id bigint")
    assert told(history.cleared(state, gone)) == {1: (5, (), (), (), False, 3), 2: (6, (1,), (), (), False, 1)}
