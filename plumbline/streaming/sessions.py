"""Open drawings of a session: opening, switching, moving and closing them, and work in flight whose results arrive when its drawing may be set aside.

A session's log is read in order, with no more held than its state: the open drawings, their images, what waits for each and what is in flight. In batch, sessions
are dealt out by key and sorted; a session that runs on is not collected. stream() keeps the same state between batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_OPEN = 6  # fixed value
RESULT = "session bigint, seq bigint, kind string, result string, active bigint, tabs array<bigint>, waiting bigint, in_flight bigint, value bigint"


def begun() -> dict:
    """A new session: one drawing, number 0, without an image."""
    return {"tabs": [0], "active": 0, "docs": {"0": new_document()}, "work": {}}


def new_document() -> dict:
    """What a drawing holds: image, value (the last result applied), results that wait for it, and whether its scale must be set again."""
    return {"image": None, "value": None, "inbox": [], "rescale": False}


def _adopt(s: dict, doc: int) -> None:
    """Makes a drawing active; what waited for it is applied in the order it came."""
    s["active"] = doc
    one = s["docs"][str(doc)]
    for value in one["inbox"]:
        one["value"] = value
    one["inbox"] = []


def apply(s: dict, seq: int, kind: str, doc: int | None, arg: int | None) -> str:
    """One command on a session's state, and what becomes of it.

    open: a drawing of the command's number, unless MOST_OPEN are. switch, close: of a drawing. move: to a place. image: the active one's. begin: work on the
    active one, under the command's number. settle: of work arg. deliver, calibrate: the result of work arg; calibrations are not kept for later. Results are
    applied, routed (kept until the drawing is active again), refused, stale (the image has changed) or dropped (the drawing was closed).
    """
    tabs, docs = s["tabs"], s["docs"]
    if kind == "open":
        if len(tabs) >= MOST_OPEN:
            return "full"
        tabs.append(seq)
        docs[str(seq)] = new_document()
        _adopt(s, seq)
        return "opened"
    if kind in ("switch", "close", "move") and doc not in tabs:
        return "none"
    if kind == "switch":
        if doc == s["active"]:
            return "same"
        _adopt(s, doc)
        return "switched"
    if kind == "move":
        at, to = tabs.index(doc), max(0, min(len(tabs) - 1, arg or 0))
        if at == to:
            return "same"
        tabs.insert(to, tabs.pop(at))
        return "moved"
    if kind == "close":
        at = tabs.index(doc)
        tabs.remove(doc)
        del docs[str(doc)]
        s["work"] = {k: w for k, w in s["work"].items() if w["doc"] != doc}
        if not tabs:
            fresh = -seq
            tabs.append(fresh)
            docs[str(fresh)] = new_document()
            _adopt(s, fresh)
        elif s["active"] == doc:
            _adopt(s, tabs[max(0, at - 1)])
        return "closed"
    if kind == "image":
        docs[str(s["active"])]["image"] = arg
        return "set"
    if kind == "begin":
        s["work"][str(seq)] = {"doc": s["active"], "image": docs[str(s["active"])]["image"], "settled": False}
        return "begun"
    work = s["work"].get(str(arg))
    if kind == "settle":
        if work is None or work["settled"]:
            return "none"
        work["settled"] = True
        return "settled"
    if work is None or str(work["doc"]) not in docs:
        return "dropped"
    one = docs[str(work["doc"])]
    if one["image"] != work["image"]:
        return "stale"
    if work["doc"] == s["active"]:
        one["value"] = seq
        one["rescale"] = False if kind == "calibrate" else one["rescale"]
        return "applied"
    if kind == "calibrate":
        one["rescale"] = True
        return "refused"
    one["inbox"].append(seq)
    return "routed"


def _row(session: int, c, s: dict) -> tuple:
    opt = lambda v: None if v is None or pd.isna(v) else int(v)
    result = apply(s, int(c.seq), c.kind, opt(c.doc), opt(c.arg))
    flight = sum(not w["settled"] for w in s["work"].values())
    return session, int(c.seq), c.kind, result, s["active"], list(s["tabs"]), sum(len(d["inbox"]) for d in s["docs"].values()), flight, s["docs"][str(s["active"])]["value"]


_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({"value": "Int64"})


def replay(log: DataFrame) -> DataFrame:
    """RESULT of every command. log: session, seq, kind, doc, arg; the numbers of commands are above 0 and apart within a session."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, s = None, None
        for f in frames:
            rows = []
            for c in f.itertuples():
                if c.session != at:
                    at, s = c.session, begun()
                rows.append(_row(int(at), c, s))
            yield _frame(rows)

    return log.select("session", "seq", "kind", "doc", "arg").repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, RESULT)


def stream(log: DataFrame) -> DataFrame:
    """The same on a stream: each batch's commands with what became of them (append mode), in the order of seq within a batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else begun()
        rows = [_row(int(key[0]), c, s) for c in pd.concat(list(frames)).sort_values("seq").itertuples()]
        state.update((json.dumps(s),))
        yield _frame(rows)

    return log.groupBy("session").applyInPandasWithState(run, RESULT, "state string", "append", GroupStateTimeout.NoTimeout)


def inbox(log: DataFrame) -> DataFrame:
    """(session, seq, doc, fate, at, place) of each result that came while its drawing was set aside: replayed when the drawing is shown next, at that command and in which place among those that waited, or lost when it is
    closed before, or waiting still. By as-of windows, without state.

    log: session, seq, kind (show, close, routed), doc.
    """
    later = W.partitionBy("session", "doc").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    next_ = lambda k: F.min(F.when(F.col("kind") == k, F.col("seq"))).over(later)
    seen = log.withColumns({"shown": next_("show"), "shut": next_("close")}).filter("kind = 'routed'")
    fate = F.when(F.col("shown") < F.coalesce("shut", F.col("shown") + 1), "replayed").when(F.col("shut").isNotNull(), "lost").otherwise("waiting")
    out = seen.withColumn("fate", fate).withColumn("at", F.when(F.col("fate") == "replayed", F.col("shown")).when(F.col("fate") == "lost", F.col("shut")))
    return out.select("session", "seq", "doc", "fate", "at", F.row_number().over(W.partitionBy("session", "doc", "at").orderBy("seq")).cast("bigint").alias("place"))


def in_flight(log: DataFrame) -> DataFrame:
    """log with work: how many units each drawing has begun and not settled after each row. A close settles all that it began. log: session, seq, kind (begin, settle, close), doc, unit."""
    order = W.partitionBy("session", "doc").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    life = log.withColumn("_life", F.sum(F.when(F.col("kind") == "close", 1).otherwise(0)).over(order))
    once = W.partitionBy("session", "doc", "_life", "unit", "kind").orderBy("seq")
    known = F.max(F.when(F.col("kind") == "begin", F.col("seq"))).over(W.partitionBy("session", "doc", "_life", "unit"))
    first = F.row_number().over(once) == 1
    step = F.when((F.col("kind") == "begin") & first, 1).when((F.col("kind") == "settle") & first & (known < F.col("seq")), -1).otherwise(0)
    within = W.partitionBy("session", "doc", "_life").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return life.withColumn("_s", step).withColumn("work", F.sum("_s").over(within).cast("bigint")).drop("_s", "_life")


def alive(beats: DataFrame, window: str = "250 milliseconds") -> DataFrame:
    """(window, sessions): which sessions answered within each window of a roll-call; batch or stream. beats: session, ts."""
    return beats.groupBy(F.window("ts", window)).agg(F.sort_array(F.collect_set("session")).alias("sessions")).select(F.col("window.start").alias("begin"), "sessions")


def kept_areas(figures: DataFrame) -> DataFrame:
    """(workspace, doc, area): what each drawing last reported while it was live; a drawing whose figure is none or zero has none. figures: workspace, doc, seq, area."""
    last = figures.groupBy("workspace", "doc").agg(F.max_by("area", "seq").alias("area"))
    return last.withColumn("area", F.when(F.col("area") > 0, F.col("area")))
