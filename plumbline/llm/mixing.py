"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words, then seeded choice of blocks.

Each source's documents stand in a seeded order and are cut into blocks of BLOCK words across document borders; what is left at the end of
a source, fewer words than a block, is cut into blocks of one word. Blocks go to sources by the highest quotients target / (2 k + 1), which
is an integer quota for each source; then the blocks of one word do, by what each source still lacks of its target, so that sources smaller
than a block have their share. Every block of a source is used the same whole number of times, and the uses left go to its shards of SHARD
blocks: the k-th at the place (2 k + 1) / 2 of equal steps along the source, which is the same rule of quotients laid on a line, so each
shard has an integer quota and the sum is the source's. Within a shard the blocks with the lowest seeded hashes are used once more. Which
those are depends on the seed, the source and the shard alone, so any task can tell and no table of blocks is needed.

Sources may be as many as rows: their sums stay a table, and what comes to the driver is one row of sums for each step of a search. Targets come from the one rate that shares
out what capped sources leave. Seats by the highest quotients are those of a divisor d, round(target / d) each, that is searched by CUTS at a time;
sources that tie at the divisor get theirs in their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._bytes import U, mix
from plumbline.llm._store import Workspace

BLOCK, SHARD, SEED, REPEATS = 16, 1024, 17, 3
WEIGHTS = (1, 2, 3)
#: Words of a bucket of documents that one task puts in order, and buckets whose sums one task adds up.
BUCKET, GROUP = 200_000, 4096
#: Places that one step of a search tries.
CUTS = 48


def word_count(text) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, work: Workspace, name: str, *order: str) -> DataFrame:
    """df with a long column number, from 0 in the order of columns that together are unique. Ranges are dealt out and counted, so no task holds all."""
    dealt = work.save(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each shuffle partition
    before = counts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inner = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("inner", inner).join(before, "part").withColumn("number", F.col("before") + F.col("inner")).drop("part", "inner", "before")


def rate_of(sources: DataFrame, repeats: int = REPEATS) -> float:
    """Words a unit of weight: a source's target is weight times that, or repeats times its size if that is less. All words of sources (size, weight) are shared out."""
    whole = float(sources.agg(F.sum("size").alias("n")).first()["n"] or 0)
    rate = 0.0
    while True:
        full = F.col("weight") * rate > repeats * F.col("size") if rate else F.col("size") == 0
        row = sources.agg(F.sum(F.when(full, repeats * F.col("size"))).alias("cut"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return float("inf")
        now = (whole - (row["cut"] or 0)) / row["open"]
        if now <= rate:
            return rate
        rate = now


def target_of(rate: float, repeats: int = REPEATS) -> Column:
    return F.least(F.lit(float(repeats)) * F.col("size"), F.lit(rate) * F.col("weight")) if np.isfinite(rate) else F.lit(float(repeats)) * F.col("size")


def _seats_of(want: Column, most: Column, divisor: Column) -> Column:
    return F.least(most, F.floor(want / divisor + 0.5)).cast("long")


def _sums_at(df: DataFrame, places: list, value: Callable[[Column], Column]) -> list[int]:
    """The sum of value(place) over df for each of a few places, in one pass."""
    at = df.withColumn("_p", F.explode(F.array(*map(F.lit, places)))).groupBy("_p").agg(F.sum(value(F.col("_p"))).alias("n"))
    found = {r["_p"]: int(r["n"] or 0) for r in at.collect()}  # a row for each place
    return [found.get(p, 0) for p in places]


def _search(counts: Callable[[list[float]], list[int]], seats: int, lo: float, hi: float) -> tuple[float, float]:
    """The places (lo, hi) around the step of a falling count that passes seats, or one place twice that gives seats just so. counts(lo) >= seats >= counts(hi)."""
    while True:
        places = sorted({lo + (hi - lo) * k / (CUTS + 1) for k in range(1, CUTS + 1)} - {lo, hi})
        if not places:
            return lo, hi
        for p, n in zip(places, counts(places)):
            if n == seats:
                return p, p
            lo, hi = (p, hi) if n > seats else (lo, min(hi, p))


def quota_of(sources: DataFrame, want: Column, most: Column, unit: int) -> Column:
    """Sainte-Laguë: as many seats as sum(want) has units, rounded, go one by one to the highest want / (2 k + 1), k seats held; none gets over most. Ties go to
    the lower number. sources: number and what want and most, an integer and unit * most >= want, are made of."""
    ask = lambda *c: list(sources.agg(*c).first())
    whole = float(ask(F.sum(want))[0] or 0)
    seats = int(whole / unit + 0.5)
    counts = lambda places: _sums_at(sources, places, lambda d: _seats_of(want, most, d))
    if not seats:
        return F.lit(0).cast("long")
    at, low = counts([float(unit), unit / 2.0])
    if at == seats:
        return _seats_of(want, most, F.lit(float(unit)))
    lo = float(unit)
    if at < seats:
        lo /= 2
        while low < seats and lo > unit / 2**40:
            lo /= 2
            low = counts([lo])[0]
    lo, hi = _search(counts, seats, lo, 2.0 * unit)
    if lo == hi:
        return _seats_of(want, most, F.lit(lo))
    few, more = _seats_of(want, most, F.lit(hi)), _seats_of(want, most, F.lit(lo))
    missing = seats - int(ask(F.sum(few))[0])
    last = int(ask(F.max("number"))[0])
    tied = sources.withColumn("_more", more - few).filter("_more > 0")
    upto = lambda places: _sums_at(tied, places, lambda p: F.when(F.col("number") <= p, F.col("_more")))
    a, b = 0, int(ask(F.max("number"))[0])  # the least number up to which the tied ones have no seat missing
    while a < b:
        places = sorted({a + (b - a) * k // CUTS for k in range(CUTS)})
        for p, n in zip(places, upto(places)):
            if n >= missing:
                b = p
                break
            a = p + 1
    return F.when(F.col("number") <= b, more).otherwise(few)


def _seats_before(place: np.ndarray, blocks: int, extra: int) -> np.ndarray:
    """How many of extra uses, laid on the line of blocks at (k + 1/2) * blocks / extra, come before a block."""
    return (2 * place * extra + blocks - 1) // (2 * blocks)


def uses(shard: int, number: int, blocks: int, quota: int, seed: int = SEED) -> np.ndarray:
    """How often each block of one shard of a source is used."""
    lo, hi = shard * SHARD, min((shard + 1) * SHARD, blocks)
    base, extra = divmod(quota, blocks)
    out = np.full(hi - lo, base, np.int64)
    if extra:
        seats = np.array([lo, hi], dtype=object)
        r = int(_seats_before(seats, blocks, extra)[1] - _seats_before(seats, blocks, extra)[0])
        h = mix(mix(np.arange(lo, hi, dtype=U) + U(seed << 40)) ^ U(number))
        out[np.argsort(h, kind="stable")[:r]] += 1
    return out


def apportioned(totals: DataFrame, work: Workspace, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """totals (source, size) with number, target, quota (of blocks) and rest (of single words): sources by code point, null last, weigh the weights in turn."""
    told = numbered(totals.withColumn("none", F.col("source").isNull()), work, "totals", "none", "source").drop("none")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    told = work.save(told.withColumn("weight", turn), "sources")
    told = told.withColumn("target", target_of(rate_of(told, repeats), repeats))
    most = (repeats * F.floor(F.col("size") / BLOCK)).cast("long")
    told = told.withColumn("quota", quota_of(told, F.least(F.col("target"), most * float(BLOCK)), most, BLOCK))
    odd = (repeats * (F.col("size") % BLOCK)).cast("long")
    lacks = F.least(F.greatest(F.col("target") - F.col("quota") * BLOCK, F.lit(0.0)), odd.cast("double"))
    return told.withColumn("rest", quota_of(told, lacks, odd, 1)).drop("weight")


def _taken(place: int, n: int, number: int, size: int, quota: int, rest: int, seed: int, held: dict) -> int:
    """Words that the mix takes of n words from a place of a source on, repeats counted."""
    whole = size // BLOCK * BLOCK
    total = 0
    for lo, hi, unit, first, blocks, seats, who in ((place, min(place + n, whole), BLOCK, 0, size // BLOCK, quota, number), (max(place, whole), place + n, 1, whole, size - whole, rest, ~number & (1 << 62) - 1)):
        if lo >= hi:
            continue
        a, b = (lo - first) // unit, (hi - first - 1) // unit
        used = []
        for s in range(a // SHARD, b // SHARD + 1):
            at = (s, who, blocks, seats)
            if at not in held:
                if len(held) > 256:
                    held.clear()
                held[at] = uses(*at, seed=seed)
            used.append(held[at][max(a - s * SHARD, 0) : b + 1 - s * SHARD])
        edge = np.arange(a, b + 2) * unit + first
        edge[0], edge[-1] = lo, hi
        total += int((np.concatenate(used) * np.diff(edge)).sum())
    return total


def mix_sources(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, carry: tuple = ()) -> DataFrame:
    """(key, size, source_size, target, taken) of every row of docs, and the columns of carry.

    A null text has size 0; a null source is a source of its own. Documents stand in the order of a seeded hash of key and text's size,
    then key and a hash of the text: rows that repeat are documents of their own, next to each other. A source of no words has target 0. No rows give no rows.
    The sizes are counted once and written, with the columns of carry. Documents are put in order in buckets of BUCKET words, and buckets are added up in
    groups of GROUP, so that a source that holds a third of all rows is many tasks' work.
    """
    rest = [f"c{i}" for i in range(len(carry))]
    kind = docs.schema[key].dataType
    base = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tx"), *[F.col(f"`{c}`").alias(r) for c, r in zip(carry, rest)])
    base = work.save(base, "sizes")
    told = apportioned(base.groupBy("source").agg(F.sum("size").alias("size")), work)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("size") / BUCKET))
    table = work.save(told.select(F.col("source").alias("name"), "number", F.col("size").alias("source_size"), "target", "quota", "rest", buckets.alias("buckets")), "shares")
    one = base.join(table, base.source.eqNullSafe(table.name)).drop("source", "name")  # Spark broadcasts the table if it is small
    one = one.withColumn("order", F.xxhash64(F.lit(seed), "id", "size")).withColumn("bucket", F.floor(F.shiftrightunsigned("order", 11) / float(1 << 53) * F.col("buckets")).cast("long"))
    group = F.floor(F.col("bucket") / GROUP).alias("group")
    part = work.save(one.groupBy("number", group, "bucket").agg(F.sum("size").alias("n")), "buckets")
    upto = lambda *by: F.sum("n").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    groups = part.groupBy("number", "group").agg(F.sum("n").alias("n")).select("number", "group", upto("number", "group").alias("g"))
    before = part.withColumn("b", upto("number", "group", "bucket")).join(groups, ["number", "group"]).select("number", "bucket", (F.col("g") + F.col("b")).alias("start"))
    inner = W.partitionBy("number", "bucket").orderBy("order", "id", "tx").rowsBetween(W.unboundedPreceding, 0)
    placed = one.withColumn("upto", F.sum("size").over(inner)).join(before, ["number", "bucket"]).withColumn("place", F.col("start") + F.col("upto") - F.col("size"))

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            col = [batch.column(i).to_pylist() for i in range(6)]
            taken = [_taken(*row, seed, held) if row[1] else 0 for row in zip(*col)]
            more = [batch.column(i) for i in range(6, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.int64()), batch.column(1), batch.column(3), *more], ["taken", "size", "source_size", "target", "id", *rest])

    shape = placed.select("place", "size", "number", "source_size", "quota", "rest", "target", "id", *rest)
    extra = "".join(f", {r} {shape.schema[r].dataType.simpleString()}" for r in rest)
    out = shape.mapInArrow(run, f"taken long, size long, source_size long, target double, id {kind.simpleString()}{extra}")
    return out.select(F.col("id").alias(key), "size", "source_size", "target", "taken", *[F.col(r).alias(c) for c, r in zip(carry, rest)])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "mixing"))
