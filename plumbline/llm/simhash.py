"""Near-duplicate documents by 64-bit SimHash and Golay-code fuzzy hashing.

A fingerprint is cut in three segments of at most 23 bits. The Golay code of length 23 is perfect: a ball of radius 4
around any word holds one code word, or six. Two words that differ in at most two bits have one of those code words in common,
that nearest to a word halfway between them. A fingerprint's keys are, for each segment, each code word of its
ball together with two of the four halves of the other segments, as they are. That is 96 keys on average, of 33 bits or so each.

By pigeonhole four differing bits leave such a key unchanged: if one segment has none, its two halves are equal, and of the others one has
two at most; if each has some, they have 2, 1, 1 or less, and in the two with one bit, one half each is equal.

Equal keys meet in sorted partitions, where the distances are verified. Within a run of equal keys only a spanning forest of its
links is told: that is all that components need, and a group of thousands of near copies gives thousands of links, not millions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._store import Workspace
from plumbline.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
CUTS = (22, 21, 21)  # bits of the segments, from the lowest
GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
U = np.uint64


def fingerprint(raw: bytes | None) -> int:
    """The SimHash of a text's bytes; zero if it has no word."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - SHINGLE + 1)
    last = end[SHINGLE - 1 :] if len(words) >= SHINGLE else end[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(start[lo : min(n, lo + (1 << 15))].tolist(), last[lo : lo + (1 << 15)].tolist())], U)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(U)[0])


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns but the text, which becomes fp long, the fingerprint's 64 bits."""
    keep = [c for c in df.columns if c != text]

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x) for x in batch.column(len(keep)).to_pylist()], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(fp)], [*keep, "fp"])

    source = df.select(*keep, F.encode(F.col(text), "UTF-8").alias("raw"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], "fp long"])
    return source.mapInArrow(run, schema)


def _remainders() -> np.ndarray:
    """The remainder of x^11 m for each 12-bit m."""
    out = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ GENERATOR << bit - 11, out)
    return out


class Golay:
    """Code words near any 23-bit word, by its syndrome."""

    def __init__(self):
        self.high = _remainders()
        found: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                found[int(self.high[e >> 11]) ^ e & 0x7FF].append(e)
        self.width = max(map(len, found))
        self.errors = np.array([x + [-1] * (self.width - len(x)) for x in found], np.int64)

    def near(self, words: np.ndarray) -> np.ndarray:
        """(words, width): 12-bit numbers of the code words within four bits of each word, -1 where there are no more."""
        e = self.errors[self.high[words >> 11] ^ words & 0x7FF]
        return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


_golay: list[Golay] = []


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp) of all keys of fingerprints, given as int64."""
    if not _golay:
        _golay.append(Golay())
    x, low, segment, halves = fp.view(U), 0, [], []
    for bits in CUTS:
        s = ((x >> U(low)) & U((1 << bits) - 1)).astype(np.int64)
        segment.append(s)
        half = bits // 2
        halves.append((s & (1 << half) - 1, s >> half))
        low += bits
    out, at = [], []
    for f in range(3):
        near = _golay[0].near(segment[f])
        row, col = np.nonzero(near >= 0)
        code = near[row, col]
        rest = [h for g in range(3) if g != f for h in halves[g]]
        for p, (a, b) in enumerate(combinations(range(4), 2)):
            out.append(((f * 6 + p) << 36 | code << 24) + (rest[a][row] << 12 | rest[b][row]))
            at.append(row)
    return np.concatenate(out), np.concatenate(at)


def forest(run: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one run of fingerprints. Each round takes out what is reached, so close groups cost little more than their size."""
    out: list[tuple[int, int]] = []
    rest = run
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            p = reached.pop()
            hit = np.bitwise_count(rest ^ p) <= DISTANCE
            if hit.any():
                new = rest[hit]
                rest = rest[~hit]
                out += [(int(p), int(q)) for q in new]
                reached += list(new)
    return out


def _links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """(n, 2) fingerprints that differ in at most DISTANCE bits, spanning each run of equal keys; key is sorted."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(new, len(key)))
    small = np.repeat(size <= 4, size)
    out = []
    for step in (1, 2, 3):
        a, b = fp[:-step], fp[step:]
        hit = (key[step:] == key[:-step]) & small[step:]
        hit[hit] = (np.bitwise_count(a[hit] ^ b[hit]) <= DISTANCE) & (a[hit] != b[hit])
        out.append(np.stack([a[hit], b[hit]], axis=1))
    for lo, n in zip(new[size > 4], size[size > 4]):
        found = forest(np.unique(fp[lo : lo + n]))
        if found:
            out.append(np.array(found, U))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) whose components are those of all links."""

    def emit(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 2048):
                part = fps[lo : lo + 2048]
                key, at = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], ["key", "fp"])

    def meet(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the run at the end, which may go on in the next batch
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if held and key[0] == held[0][0][0] and not last:
                held.append((key, fp))
                continue
            if held or last:
                front = [*held, (key[:last], fp[:last])]
                yield told(_links(np.concatenate([k for k, _ in front]), np.concatenate([f for _, f in front])))
            held = [(key[last:], fp[last:])]
        if held:
            yield told(_links(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])))

    def told(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[:, k].view(np.int64)) for k in (0, 1)], ["a", "b"])

    met = distinct.select("fp").mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(meet, "a long, b long").distinct()


def groups(marked: DataFrame, work: Workspace, by: list[str]) -> DataFrame:
    """(fp, least): for each fingerprint of marked, the least of struct(by) in its component. marked: fp and the columns of by."""
    distinct = work.save(marked.groupBy("fp").agg(F.min(F.struct(*by)).alias("least")), "distinct")
    found = components(work.save(links(distinct), "links"), work)
    linked = work.save(distinct.join(found, distinct.fp == found.node).select("fp", "root", "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("whole"))
    whole = linked.join(least, "root").select("fp", "whole")
    return distinct.join(whole, "fp", "left").select("fp", F.coalesce("whole", "least").alias("least"))


def near_duplicates(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row of docs; component_id is the least key that can be reached over links.

    A null or wordless text has fingerprint zero, linked like any other. Rows that repeat are rows of their own in the result. A null key is
    passed over as least key, unless a component has no other. No rows give no rows. Other columns aren't read.
    """
    marked = work.save(fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))), "marked")
    # nulls sort first in a struct, so a flag goes before the key
    least = groups(marked.withColumn("none", F.col("id").isNull()), work, ["none", "id"])
    out = marked.join(least, "fp")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of docs, that of the least key; of rows with the same key, one by a hash of the text. Columns stay as they are."""
    names = docs.columns
    mark = [F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tx")]
    marked = work.save(fingerprints(docs.select(*mark, F.col(text).alias("text"))), "marked")
    best = groups(marked, work, ["none", "id", "tx"]).select("least").distinct()
    again = marked.groupBy("id", "tx").agg(F.count("*").alias("n"))
    best = best.join(again, F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.tx") == F.col("tx"))).select(F.xxhash64("id", "tx").alias("i1"), F.xxhash64("tx", "id", F.lit(1)).alias("i2"), (F.col("n") > 1).alias("again"))
    best = work.save(best, "best")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.xxhash64(F.col(key), F.xxhash64(F.col(text))).alias("i1"), F.xxhash64(F.xxhash64(F.col(text)), F.col(key), F.lit(1)).alias("i2"))
    once = row.join(best.filter("NOT again"), ["i1", "i2"]).select("r")
    twice = row.join(best.filter("again"), ["i1", "i2"]).dropDuplicates(["i1", "i2"]).select("r")
    return once.union(twice).select(*[F.col(f"r.`{c}`").alias(c) for c in names])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "simhash"))
