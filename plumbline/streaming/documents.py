"""What becomes of results that arrive late, of edits that pause, and of sessions that fall silent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUIET = "30 minutes"
ALIVE_SECONDS, KEEP_DAYS = 90, 7  # fixed values


def verdicts(log: DataFrame) -> DataFrame:
    """(session, seq, doc, verdict) of each deliver in the log.

    log: session, seq, kind, doc, image, begun. Kinds: show (doc becomes active, with an image), close, and deliver, of work that began at seq begun for doc and image.
    A result is dropped if its document was closed since it began; else it is applied to the active document, or routed to a parked one, if that still has
    the image, and else stale. One that would be routed but can't be replayed later (replayable is false, as of a scale) is refused. All by as-of lookups: the last
    thing the log says before the delivery.
    """
    order = W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    of_doc = W.partitionBy("session", "doc").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    show = F.col("kind") == "show"
    seen = log.withColumns({
        "active": F.last(F.when(show, F.col("doc")), True).over(order),
        "held": F.last(F.when(show, F.col("image")), True).over(of_doc),
        "closed": F.max(F.when(F.col("kind") == "close", F.col("seq"))).over(of_doc),
    })
    replayable = F.coalesce("replayable", F.lit(True)) if "replayable" in log.columns else F.lit(True)
    out = F.when(F.col("closed") > F.col("begun"), "dropped").when(~F.col("held").eqNullSafe(F.col("image")), "stale").when(F.col("active") == F.col("doc"), "applied").when(~replayable, "refused").otherwise("routed")
    return seen.filter("kind = 'deliver'").select("session", "seq", "doc", out.alias("verdict"))


def autosaves(edits: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(doc_id, first, last, n, state): a save for each stretch of edits without a pause of quiet; moves of the camera are no edits. Batch or stream (with a watermark on ts)."""
    real = edits.filter("kind != 'camera'")
    w = real.groupBy("doc_id", F.session_window("ts", quiet).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.max_by("state", F.struct("ts", "seq")).alias("state"))
    return w.drop("w")


def scans_once(requests: DataFrame) -> DataFrame:
    """The first request of each image; on a stream, of those within the watermark of ts."""
    if requests.isStreaming:
        return requests.dropDuplicatesWithinWatermark(["image"])
    first = requests.groupBy("image").agg(F.min(F.struct("ts", "seq")).alias("f"))
    return first.select("image", "f.ts", "f.seq")


def adopted(indexes: DataFrame, live: DataFrame, now) -> DataFrame:
    """The workspace to take over: the newest of those that no live session claims and that are older than ALIVE_SECONDS. indexes: workspace, saved_at. live: workspace."""
    idle = indexes.join(live, "workspace", "left_anti").filter(F.unix_timestamp("saved_at") < F.unix_timestamp(now) - ALIVE_SECONDS)
    return idle.orderBy(F.desc("saved_at"), "workspace").limit(1)


def orphans(records: DataFrame, indexes: DataFrame, now) -> DataFrame:
    """The records that no surviving index names; an index survives KEEP_DAYS. records: doc_id. indexes: workspace, saved_at, and docs (an array) or, with a row for each of them, doc_id."""
    kept = indexes.filter(F.unix_timestamp("saved_at") >= F.unix_timestamp(now) - KEEP_DAYS * 86400)
    named = kept.select("doc_id") if "doc_id" in kept.columns else kept.select(F.explode("docs").alias("doc_id"))
    return records.join(named, "doc_id", "left_anti")
