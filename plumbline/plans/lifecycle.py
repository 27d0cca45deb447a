"""Queries on histories, late results, saves and project files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geom
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.sources import projects
from plumbline.sources.tables import Workspace
from plumbline.streaming import documents, history


def commands(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "undo").when(F.col("event_type") == "signup", "redo").when(F.col("event_type") == "error", "cancel").otherwise("save")
    return V.read(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), kind.alias("command"), F.col("event_id").alias("state"))


_UNDO = """
WITH RECURSIVE c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'signup' THEN 'redo' WHEN 'error' THEN 'cancel' ELSE 'save' END AS k FROM events),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS now, []::BIGINT[] AS undo, []::BIGINT[] AS redo, []::BIGINT[] AS held, false AS fresh FROM events
  UNION ALL
  SELECT s.user_id, c.i,
    CASE WHEN k = 'save' THEN c.event_id WHEN (k = 'undo' AND len(undo) > 0) OR (k = 'cancel' AND fresh) THEN undo[-1] WHEN k = 'redo' AND len(redo) > 0 THEN redo[-1] ELSE now END,
    CASE WHEN k = 'save' OR (k = 'redo' AND len(redo) > 0) THEN list_append(undo, now)[-50:] WHEN (k = 'undo' AND len(undo) > 0) OR (k = 'cancel' AND fresh) THEN undo[:-2] ELSE undo END,
    CASE WHEN k = 'save' THEN [] WHEN k = 'undo' AND len(undo) > 0 THEN list_append(redo, now)[-50:] WHEN k = 'redo' AND len(redo) > 0 THEN redo[:-2] WHEN k = 'cancel' AND fresh THEN held ELSE redo END,
    CASE WHEN k = 'save' THEN redo ELSE [] END, k = 'save'
  FROM s JOIN c ON c.user_id = s.user_id AND c.i = s.i + 1
)
SELECT user_id AS doc_id, arg_max(now, i) AS now, len(arg_max(undo, i))::BIGINT AS undo, len(arg_max(redo, i))::BIGINT AS redo, max(i) AS n FROM s GROUP BY user_id"""


@query(_UNDO)
def undo_history(spark: SparkSession, d: str) -> DataFrame:
    return history.fold(commands(spark, d))


@query(_UNDO)
def resumed_histories(spark: SparkSession, d: str) -> DataFrame:
    """The histories of undo_history, put aside as records in the middle of the log, and taken up again."""
    all_, work = commands(spark, d), Workspace(spark, "history")
    middle = all_.agg(F.timestamp_micros(((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2).cast("bigint")).alias("m"))
    cut = all_.join(F.broadcast(middle))  # one row
    record = work.save(history.records(history.states(cut.filter("ts < m").drop("m"))), "records")
    end = history.states(cut.filter("ts >= m").drop("m"), history.adopted(record))
    return end.select("doc_id", "now", F.size("undo").cast("bigint").alias("undo"), F.size("redo").cast("bigint").alias("redo"), "n")


_LOG = "SELECT user_id AS session, event_id AS seq, CASE WHEN event_type IN ('view', 'signup') THEN 'show' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'close' ELSE 'deliver' END AS kind, event_id % 3 AS doc, floor(value)::BIGINT % 2 AS image, event_id - 900 AS begun, event_id % 5 <> 0 AS replayable FROM events"


@query(f"""
WITH l AS ({_LOG}), q AS (SELECT * FROM l WHERE kind = 'deliver'),
a AS (SELECT q.session, q.seq, q.doc, q.image, q.begun, q.replayable, (SELECT arg_max(doc, seq) FROM l WHERE l.session = q.session AND l.seq < q.seq AND kind = 'show') AS active,
  (SELECT arg_max(image, seq) FROM l WHERE l.session = q.session AND l.doc = q.doc AND l.seq < q.seq AND kind = 'show') AS held, (SELECT max(seq) FROM l WHERE l.session = q.session AND l.doc = q.doc AND l.seq < q.seq AND kind = 'close') AS closed FROM q)
SELECT session, seq, doc, CASE WHEN closed > begun THEN 'dropped' WHEN held IS DISTINCT FROM image THEN 'stale' WHEN active = doc THEN 'applied' WHEN NOT replayable THEN 'refused' ELSE 'routed' END AS verdict FROM a""")
def late_results(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "signup"), "show").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "close").otherwise("deliver")
    log = V.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 3).alias("doc"), (F.floor("value") % 2).alias("image"), (F.col("event_id") - 900).alias("begun"), (F.col("event_id") % 5 != 0).alias("replayable"))
    return documents.verdicts(log)


def edits(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "camera").otherwise("edit").alias("kind"), F.col("event_id").alias("state"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE AS cut FROM events WHERE event_type <> 'view'), g AS (SELECT *, sum(coalesce(cut, true)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
SELECT user_id AS doc_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n, arg_max(event_id, (ts, event_id)) AS state FROM g GROUP BY user_id, g""")
def autosaves(spark: SparkSession, d: str) -> DataFrame:
    out = documents.autosaves(edits(V.read(spark, d, "events")))
    return out.withColumns({"first": F.unix_micros(F.col("first").cast("timestamp")), "last": F.unix_micros(F.col("last").cast("timestamp"))})


@query("""
WITH k AS (SELECT doc_id, text, doc_id % 7 = 0 AS bare FROM documents)
SELECT doc_id, CASE WHEN bare OR text IS NULL THEN 'empty' WHEN doc_id % 11 = 0 THEN 'no-image' ELSE 'ok' END AS status, CASE WHEN NOT bare AND doc_id % 11 <> 0 THEN length(text)::INTEGER END AS n FROM (SELECT k.* FROM k WHERE text NOT IN (SELECT text FROM k WHERE doc_id % 11 = 0) OR doc_id % 11 = 0)""")
def draft_images(spark: SparkSession, d: str) -> DataFrame:
    """Drafts split from their images and joined again, after some images were lost."""
    docs = V.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("image"), "text")
    lost = docs.filter("doc_id % 11 = 0").select(F.col("text").alias("t")).distinct()
    docs = docs.join(lost, (F.col("text") == F.col("t")) & (F.col("doc_id") % 11 != 0), "left_anti").drop("text")
    records, images = projects.split_drafts(docs)
    gone = records.filter("doc_id % 11 = 0 AND image_key IS NOT NULL").select("image_key").distinct()
    return projects.join_drafts(records, images.join(gone, "image_key", "left_anti")).select("doc_id", "status", F.length("image").alias("n"))


@query(""", m AS (SELECT plan_id, room_id, w_ft * ppf * h_ft * ppf * CASE WHEN part % 2 = 0 THEN 0.75 ELSE 1 END AS px, ppf, CASE WHEN disc > 5 THEN 1 ELSE 0 END AS holes, flag <> 'R' AS visible FROM di)
SELECT plan_id, count(*) AS traces, round(sum(px) / max(ppf) / max(ppf), 4) AS area, sum(holes)::BIGINT AS holes, count(*) FILTER (WHERE visible) AS visible, 'Plan ' || plan_id || ' x 2024-02-29.json' AS file, round(1 / max(ppf), 9) AS sx FROM m GROUP BY plan_id""", items=True)
def project_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Projects written as JSON and read again."""
    t = V.as_traces(V.distinct_items(spark, d))
    none = F.lit(None).cast("string")
    trace = F.struct(
        F.col("room_id").cast("string").alias("id"), none.alias("name"), F.col("type").alias("type"), F.col("visible").alias("visible"), F.col("ring").alias("vertices"), F.col("holes").alias("holes"),
        none.alias("nameSource"), none.alias("typeSource"), none.alias("colorSource"),
    )
    plans = t.groupBy("plan_id").agg(F.collect_list(trace).alias("traces"), F.max("fpp").alias("sx")).withColumns({"title": F.concat(F.lit("Plan "), F.col("plan_id"), F.lit(" / x?")), "unit": F.lit("decimal"), "sy": F.lit(float("nan")), "image": F.lit("data:"), "image_key": F.lit("k")})
    back = projects.parse(projects.serialize(plans))
    area = F.aggregate("p.traces", F.lit(0.0), lambda a, x: a + geom.ring_area(x["vertices"]))
    return back.select(
        "plan_id", F.size("p.traces").cast("bigint").alias("traces"), F.round(area * F.col("scale.x") * F.col("scale.x"), 4).alias("area"), F.aggregate("p.traces", F.lit(0), lambda a, x: a + F.size(x["holes"])).cast("bigint").alias("holes"),
        F.size(F.filter("p.traces", lambda x: x["visible"])).cast("bigint").alias("visible"), projects.file_name(F.col("p.metadata.title"), F.lit("2024-02-29").cast("date")).alias("file"), F.round("scale.x", 9).alias("sx"),
    )


@query("""
WITH i AS (SELECT user_id AS workspace, max(ts) AS saved_at, list(event_id) AS docs FROM events GROUP BY user_id), k AS (SELECT unnest(docs) AS doc_id FROM i WHERE epoch(saved_at)::BIGINT >= 1706313600 - 7 * 86400 AND workspace % 5 > 0)
SELECT event_id AS doc_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM k)""")
def orphan_drafts(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    saved = e.groupBy(F.col("user_id").alias("workspace")).agg(F.max("ts").alias("saved_at")).filter("workspace % 5 > 0")
    index = e.select(F.col("user_id").alias("workspace"), F.col("event_id").alias("doc_id")).join(saved, "workspace")
    return documents.orphans(e.select(F.col("event_id").alias("doc_id")), index, F.lit("2024-01-27 00:00:00").cast("timestamp"))
