"""Queries on sessions of open drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.streaming import documents, sessions

_KIND = "CASE WHEN event_type = 'purchase' THEN 'open' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'close' WHEN event_type = 'error' THEN 'move' ELSE 'switch' END"


def tab_log(spark: SparkSession, d: str) -> DataFrame:
    """Commands on tabs, numbered from 1: a drawing is named by the number of the command that opened it, which is one of the session's events before, or 0 for the blank one."""
    e = V.read(spark, d, "events")
    kind = F.expr(_KIND)
    return e.select(F.col("user_id").alias("session"), (F.col("event_id") + 1).alias("seq"), kind.alias("kind"), (F.floor("value").cast("bigint") % 7).alias("arg"))


@query(f"""
WITH RECURSIVE k AS (SELECT user_id, event_id + 1 AS seq, {_KIND} AS k, floor(value)::BIGINT % 7 AS arg FROM events), c AS (SELECT user_id, seq AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, k, arg FROM k),
o AS (SELECT c.*, (SELECT max(b.event_id) FROM c b WHERE b.user_id = c.user_id AND b.k = 'open' AND b.event_id < c.event_id - 300 * (c.arg % 3)) AS doc FROM c),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, [0]::BIGINT[] AS tabs, 0::BIGINT AS active, 'none' AS result, 0::BIGINT AS seq FROM c
  UNION ALL
  SELECT user_id, i, tabs2, CASE WHEN result = 'opened' THEN seq WHEN result = 'switched' THEN doc WHEN result = 'closed' AND len(rest) = 0 THEN -seq WHEN result = 'closed' AND active = doc THEN rest[greatest(place - 1, 1)] ELSE active END, result, seq
  FROM (
    SELECT *, CASE result WHEN 'opened' THEN list_append(tabs, seq) WHEN 'closed' THEN CASE WHEN len(rest) = 0 THEN [-seq] ELSE rest END WHEN 'moved' THEN list_concat(list_concat(rest[1:dest], [doc]), rest[dest + 1:]) ELSE tabs END AS tabs2
    FROM (
      SELECT *, CASE k WHEN 'open' THEN CASE WHEN len(tabs) >= 6 THEN 'full' ELSE 'opened' END ELSE CASE WHEN place = 0 THEN 'none' WHEN k = 'close' THEN 'closed' WHEN k = 'switch' THEN CASE WHEN doc = active THEN 'same' ELSE 'switched' END WHEN place - 1 = dest THEN 'same' ELSE 'moved' END END AS result
      FROM (
        SELECT s.user_id, o.i, s.tabs, s.active, o.k, o.event_id AS seq, coalesce(o.doc, 0) AS doc, coalesce(list_position(s.tabs, coalesce(o.doc, 0)), 0) AS place, list_filter(s.tabs, lambda t: t <> coalesce(o.doc, 0)) AS rest, least(len(s.tabs) - 1, o.arg) AS dest
        FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1
      )
    )
  )
)
SELECT user_id AS session, seq, result, active, array_to_string(tabs, ',') AS tabs FROM s WHERE i > 0""")
def document_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Drawings opened, switched to, moved and closed: what became of each command, and the tabs after it."""
    from pyspark.sql import Window as W

    log = tab_log(spark, d)
    opened = F.when(F.col("kind") == "open", F.col("seq"))
    # the drawing that a command names: the last one opened some 300 or 600 numbers before
    back = [F.coalesce(F.max(opened).over(W.partitionBy("session").orderBy("seq").rangeBetween(W.unboundedPreceding, -300 * k - 1)), F.lit(0)) for k in range(3)]
    doc = F.when(F.col("arg") % 3 == 0, back[0]).when(F.col("arg") % 3 == 1, back[1]).otherwise(back[2])
    out = sessions.replay(log.withColumn("doc", doc))
    return out.select("session", "seq", "result", "active", F.array_join(F.transform("tabs", lambda t: t.cast("string")), ",").alias("tabs"))


_PARKED = "SELECT user_id AS session, event_id AS seq, event_id % 4 AS doc, CASE WHEN event_type = 'view' THEN 'show' WHEN event_type = 'error' AND event_id % 5 < 2 THEN 'close' ELSE 'routed' END AS kind FROM events"


@query(f"""
WITH l AS ({_PARKED}), q AS (SELECT l.*, (SELECT min(seq) FROM l s WHERE s.session = l.session AND s.doc = l.doc AND s.seq > l.seq AND s.kind = 'show') AS shown, (SELECT min(seq) FROM l s WHERE s.session = l.session AND s.doc = l.doc AND s.seq > l.seq AND s.kind = 'close') AS shut FROM l WHERE kind = 'routed'),
f AS (SELECT session, seq, doc, CASE WHEN shown IS NOT NULL AND (shut IS NULL OR shown < shut) THEN 'replayed' WHEN shut IS NOT NULL THEN 'lost' ELSE 'waiting' END AS fate, least(shown, shut) AS "at" FROM q)
SELECT session, seq, doc, fate, "at", row_number() OVER (PARTITION BY session, doc, "at" ORDER BY seq) AS place FROM f""")
def parked_inbox(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "show").when((F.col("event_type") == "error") & (F.col("event_id") % 5 < 2), "close").otherwise("routed")
    return sessions.inbox(V.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("doc"), kind.alias("kind")))


_FLIGHT = "SELECT user_id AS session, event_id AS seq, event_id % 2 AS doc, floor(value)::BIGINT % 4 AS unit, CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'close' WHEN event_type IN ('view', 'click') THEN 'begin' ELSE 'settle' END AS kind FROM events"


@query(f"""
WITH l AS ({_FLIGHT}), v AS (SELECT *, (SELECT coalesce(max(c.seq), -1) FROM l c WHERE c.session = l.session AND c.doc = l.doc AND c.kind = 'close' AND c.seq <= l.seq) AS since FROM l),
b AS (SELECT session, doc, unit, since, max(seq) AS last FROM v WHERE kind = 'begin' GROUP BY ALL), f AS (SELECT session, doc, unit, since, kind, min(seq) AS seq FROM v WHERE kind <> 'close' GROUP BY ALL),
e AS (SELECT f.session, f.doc, f.since, f.seq, CASE WHEN f.kind = 'begin' THEN 1 WHEN b.last < f.seq THEN -1 ELSE 0 END AS step FROM f LEFT JOIN b USING (session, doc, unit, since))
SELECT v.session, v.seq, v.doc, v.unit, v.kind, (SELECT coalesce(sum(step), 0) FROM e WHERE e.session = v.session AND e.doc = v.doc AND e.since = v.since AND e.seq <= v.seq)::BIGINT AS work FROM v""")
def work_in_flight(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "close").when(F.col("event_type").isin("view", "click"), "begin").otherwise("settle")
    log = V.read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("doc"), (F.floor("value").cast("bigint") % 4).alias("unit"), kind.alias("kind"))
    return sessions.in_flight(log)


@query("""
WITH f AS (SELECT user_id AS workspace, event_id % 6 AS doc, arg_max(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value) END, event_id)::DOUBLE AS area FROM events GROUP BY ALL)
SELECT workspace, count(*) AS plans, count(*) FILTER (WHERE area > 0) AS measured, coalesce(sum(area) FILTER (WHERE area > 0), 0)::DOUBLE AS area FROM f GROUP BY workspace""")
def reported_areas(spark: SparkSession, d: str) -> DataFrame:
    """What a workspace's drawings last reported, added up."""
    figures = V.read(spark, d, "events").select(F.col("user_id").alias("workspace"), (F.col("event_id") % 6).alias("doc"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.floor("value").cast("double")).alias("area"))
    return sessions.kept_areas(figures).groupBy("workspace").agg(F.count("*").alias("plans"), F.count("area").alias("measured"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


@query("""
WITH i AS (SELECT user_id AS workspace, max(ts) AS saved_at FROM events GROUP BY user_id), n AS (SELECT max(saved_at) + INTERVAL 80 SECOND AS now FROM i), k AS (SELECT i.* FROM i, n WHERE workspace % 4 <> 0 AND epoch(saved_at)::BIGINT < epoch(now)::BIGINT - 90)
SELECT workspace, epoch_us(saved_at) AS saved_at FROM k ORDER BY saved_at DESC, workspace LIMIT 1""")
def adopted_workspace(spark: SparkSession, d: str) -> DataFrame:
    """The workspace that a new session takes over: the newest that is silent and that no live session claims."""
    index = V.read(spark, d, "events").groupBy(F.col("user_id").alias("workspace")).agg(F.max("ts").alias("saved_at"))
    last = index.agg(F.date_format(F.max("saved_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first()["m"]  # one value
    now = F.lit(last).cast("timestamp") + F.expr("INTERVAL 80 SECONDS")
    live = index.filter("workspace % 4 = 0").select("workspace")
    out = documents.adopted(index, live, now)
    return out.select("workspace", F.unix_micros(F.col("saved_at").cast("timestamp")).alias("saved_at"))
