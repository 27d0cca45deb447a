"""Passages that earlier documents have, found by sharded Aho-Corasick automata and cut out.

A window is 13 consecutive words. Words of a document go where a window covers them that a document with a smaller id has too.

1. Equal texts are one, with the least of their ids: a copy loses all its windows, and needs no search.
2. A window is known by its least 8-word gram, by hash. Such grams are counted, a row a text; grams of one text alone can't be part of a repeated window. What other windows make
   up, in a text without a break, is a stretch, and only stretches are searched further.
3. Windows of stretches are counted, with the least and the greatest id. Those that an earlier document has too are confirmed phrases; one text that has the least id lends its words.
4. Phrases are dealt out to shards by their least 3-word gram, which neighbours mostly share, at most PHRASES to a shard on average. A shard's task compiles its automaton of word numbers (26 nodes a phrase, whatever the words'
   length), then streams through it all stretches of all documents with one of its grams, and tells the words that earlier documents' phrases cover. Equal stretches follow each other and are matched once.

Stretches lie with their shard, so no task holds more than one automaton, and no document goes through automata that can't have anything of it. A gram that many documents share is searched
by several tasks with the same phrases, each taking a part of the documents; a gram with very many phrases is dealt out to several automata. Texts are bucketed
by their hash once, and later joins bring narrow rows to them.
"""

from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._store import Workspace, shuffles_dropped

WINDOW, GRAM, ROUTE = 13, 8, 3
PHRASES = 75_000  # of an automaton
OCCURRENCES = 1_000_000  # of the phrases of one gram, that one task searches
SPECIAL = 4096  # grams that get shards of their own, at most, in each of the two ways
WORDS = 50_000  # that are hashed at once, if a text has no more
LAST = 2**63 - 1  # a null id
U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([k]), seed) | 1 for k in range(n)], U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class _Hashes(dict):
    """Hashes of words; frequent ones are looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hash_of = _Hashes()


def _sums(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    for k, m in enumerate(_odd(n, n)):
        out += h[k : k + len(out)] * m
    return _mixed(out)


def windows(words: list[bytes], sizes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, least, own) of each window of texts that follow each other in words; sizes: how many each has. first is its first word's place in words, least the least hash
    of its grams of so many words, own its own hash, both as int64."""
    many = np.maximum(sizes - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(sizes)), many)
    first = np.arange(many.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(many) + many, many)
    if not len(first):
        return row, first, first.copy(), first.copy()
    h = np.fromiter(map(_hash_of.__getitem__, words), U, len(words))
    grams = _sums(h, gram)
    n = len(words) - WINDOW + 1
    least = grams[:n].copy()
    for k in range(1, WINDOW - gram + 1):
        np.minimum(least, grams[k : k + n], out=least)
    return row, first, least[first].view(np.int64), _sums(h, WINDOW)[first].view(np.int64)


def blocks(texts):
    """(first row, words, sizes) of rows of a binary column whose words are at most WORDS together, or one row."""
    lo, words, sizes = 0, [], []
    for k, raw in enumerate(texts):
        own = raw.as_py().split()
        if words and len(words) + len(own) > WORDS:
            yield lo, words, np.array(sizes, np.int64)
            lo, words, sizes = k, [], []
        words += own
        sizes.append(len(own))
    if sizes:
        yield lo, words, np.array(sizes, np.int64)


def runs(at: np.ndarray, *kinds: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) positions in `at` of runs of consecutive numbers whose kinds are equal."""
    if not len(at):
        return []
    cut = np.diff(at) != 1
    for k in kinds:
        cut |= k[1:] != k[:-1]
    edge = np.flatnonzero(cut)
    return list(zip(np.append(0, edge + 1).tolist(), np.append(edge, len(at) - 1).tolist()))


def _table(df: DataFrame, work: Workspace, name: str, keys: list[str]) -> DataFrame:
    """df as a table bucketed by keys, so that joins on them don't move it again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own bound on buckets
    df.write.format("parquet").option("path", work.path(name)).bucketBy(n, *keys).saveAsTable(table)
    return spark.table(table)


def _marked(docs: DataFrame, key: str, text: str, more: list[Column] = []) -> DataFrame:
    """(id, h1, h2, text, more): the id as long, null as the greatest; two hashes of the text, null as empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.lit(11), t).alias("h1"), F.xxhash64(F.lit(12), t).alias("h2"), t.alias("text"), *more)


def texts(docs: DataFrame, work: Workspace, key: str, text: str) -> DataFrame:
    """(h1, h2, first, text): each distinct text with the least id that has it."""
    m = _marked(docs, key, text).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.first("text").alias("text"))
    return _table(m, work, "texts", ["h1", "h2"])


def _rows(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def grams(distinct: DataFrame) -> DataFrame:
    """(gram, h1, h2): the grams by which the windows of each text are known, each once a text."""

    def run(batches):
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, words, sizes in blocks(batch.column(2)):
                row, _, gram, _ = windows(words, sizes, GRAM)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                row, gram = row[new], gram[new]
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                at = row[new] + lo
                yield _rows([gram[new], h1[at], h2[at]], [pa.int64()] * 3, ["gram", "h1", "h2"])

    return distinct.select("h1", "h2", F.encode("text", "UTF-8").alias("raw")).mapInArrow(run, "gram long, h1 long, h2 long")


def stretches(distinct: DataFrame, work: Workspace) -> DataFrame:
    """(uid, h1, h2, first, start, words): the stretches of each text whose windows have grams of several texts."""
    known = work.save(grams(distinct), "grams")
    several = known.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    by_text = known.join(several, "gram").groupBy("h1", "h2").agg(F.collect_list("gram").alias("grams"))

    def run(batches):
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["h1", "h2", "first", "start", "words"]
        for batch in batches:
            own, of = [batch.column(k).to_numpy() for k in range(3)], batch.column(4)
            for lo, words, sizes in blocks(batch.column(3)):
                row, first, gram, _ = windows(words, sizes, GRAM)
                hit = np.flatnonzero(np.isin(gram, of.slice(lo, len(sizes)).flatten().to_numpy()))  # a gram of several texts is one in each
                at, where = first[hit], row[hit]
                ends = runs(at, where)
                whose = where[[a for a, _ in ends]] if ends else where
                start = (at[[a for a, _ in ends]] if ends else at) - (np.cumsum(sizes) - sizes)[whose]
                yield _rows([*[c[whose + lo] for c in own], start.astype(np.int32), [b" ".join(words[at[a] : at[b] + WINDOW]) for a, b in ends]], kinds, names)

    found = distinct.join(by_text, ["h1", "h2"]).select("h1", "h2", "first", F.encode("text", "UTF-8").alias("raw"), "grams")
    out = found.mapInArrow(run, "h1 long, h2 long, first long, start int, words binary")
    told = work.save(out.withColumn("uid", F.monotonically_increasing_id()), "stretches")
    work.drop("grams")
    return told


def phrases(stretch: DataFrame, work: Workspace) -> DataFrame:
    """(gram, hash, lo, n, uid, off): the windows that a later document has too, with the least id, their number, and where one that has it, has its words. gram is the least of ROUTE words."""

    def run(batches):
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()], ["gram", "hash", "first", "uid", "off"]
        for batch in batches:
            uid, least = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, words, sizes in blocks(batch.column(2)):
                row, first, gram, own = windows(words, sizes, ROUTE)
                yield _rows([gram, own, least[row + lo], uid[row + lo], (first - (np.cumsum(sizes) - sizes)[row]).astype(np.int32)], kinds, names)

    seen = stretch.select("uid", "first", "words").mapInArrow(run, "gram long, hash long, first long, uid long, off int")
    # of equal ids both min_by keep the same row: they see the same rows in the same order
    told = seen.groupBy("gram", "hash").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.count("*").alias("n"), F.min_by("uid", "first").alias("uid"), F.min_by("off", "first").alias("off"))
    return work.save(told.filter("lo < hi").drop("hi"), "phrases")


class Shards:
    """To which shard a window goes. Most go by gram; special grams have shards of their own, by hash and by document."""

    def __init__(self, phrase: DataFrame, least: int):
        total, seen = phrase.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.n = max(least, -(-total // PHRASES))
        wide, hot = max(PHRASES // 4, total // SPECIAL), max(OCCURRENCES, seen // SPECIAL)
        found = phrase.groupBy("gram").agg(F.count("*").alias("w"), F.sum("n").alias("h")).filter((F.col("w") > wide) | (F.col("h") > hot))
        self.special, at = {}, self.n
        for r in found.sort("gram").collect():  # 2 x SPECIAL at most, by the two bounds
            parts, copies = -(-r.w // wide), -(-r.h // hot)
            self.special[r.gram] = (at, parts, copies)
            at += parts * copies

    def of(self, gram: np.ndarray, own: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The shard in which a document with that salt searches each window."""
        out = gram % self.n
        for k in np.flatnonzero(np.isin(gram, list(self.special))) if self.special else ():
            at, parts, copies = self.special[int(gram[k])]
            out[k] = at + int(own[k] % parts) * copies + int(salt[k] % copies)
        return out

    def copies(self, gram: int) -> int:
        return self.special[gram][2] if gram in self.special else 1


NAMES = ["shard", "kind", "first", "h1", "h2", "start", "words"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
SHAPE = "shard long, kind int, first long, h1 long, h2 long, start int, words binary"


def patterns(phrase: DataFrame, stretch: DataFrame, shards: Shards) -> DataFrame:
    """Rows of kind 0: the words of confirmed phrases, those that follow each other in one text together, for each shard that needs them."""

    def run(batches):
        for batch in batches:
            found = batch.column(1)
            off, lo, gram, own = (found.flatten().field(k).to_numpy().astype(np.int64) for k in range(4))
            row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
            words = [raw.split() for raw in batch.column(0).to_pylist()]
            many = np.array([shards.copies(int(g)) for g in gram], np.int64) if shards.special else np.ones(len(gram), np.int64)
            for salt in range(int(many.max(initial=0))):
                use = np.flatnonzero(salt < many)
                shard = shards.of(gram[use], own[use], np.full(len(use), salt))
                ends = runs(off[use], row[use], lo[use], shard)
                at = np.array([a for a, _ in ends], np.int64)
                cut = [b" ".join(words[row[use[a]]][off[use[a]] : off[use[b]] + WINDOW]) for a, b in ends]
                none = pa.nulls(len(at))
                yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(np.zeros(len(at), np.int32)), pa.array(lo[use[at]]), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(cut, pa.binary())], NAMES)

    lent = phrase.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("off", "lo", "gram", "hash"))).alias("found"))
    return stretch.join(lent, "uid").select("words", "found").mapInArrow(run, SHAPE)


def searched(stretch: DataFrame, shards: Shards) -> DataFrame:
    """Rows of kind 1: each stretch, cut for the shards that may have phrases of it."""

    def run(batches):
        for batch in batches:
            uid, least, h1, h2, start = (batch.column(k).to_numpy() for k in range(5))
            for lo, words, sizes in blocks(batch.column(5)):
                row, first, gram, own = windows(words, sizes, ROUTE)
                shard = shards.of(gram, own, uid[row + lo])
                ends = runs(first, row, shard)
                a = np.array([x for x, _ in ends], np.int64)
                at = row[a] + lo
                place = start[at] + first[a] - (np.cumsum(sizes) - sizes)[row[a]]
                cut = [b" ".join(words[first[x] : first[y] + WINDOW]) for x, y in ends]
                yield _rows([shard[a], np.ones(len(a), np.int32), least[at], h1[at], h2[at], place.astype(np.int32), cut], KINDS, NAMES)

    return stretch.select("uid", "first", "h1", "h2", "start", "words").mapInArrow(run, SHAPE)


def _letters(number: int) -> str:
    """A word's number, 0 for a word of no phrase, as a letter from 256 on and one below: an automaton looks through the letters that follow a node one by one, so few should."""
    return chr(256 + (number >> 8)) + chr(number & 255)


def located(rows: DataFrame) -> DataFrame:
    """(h1, h2, start, stop): words that phrases of smaller ids cover. rows: patterns and stretches."""

    def run(batches):
        now, number, machine, ready, last, met, none = None, {}, None, False, None, [], _letters(0)
        for batch in batches:
            out = []
            for shard, kind, first, h1, h2, start, raw in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if shard != now:
                    now, number, machine, ready, last = shard, {}, ahocorasick.Automaton(ahocorasick.STORE_ANY), False, None
                if kind == 0:
                    words = raw.split()
                    for w in words:
                        if w not in number:
                            number[w] = _letters(len(number) + 1)
                    line = "".join([number[w] for w in words])
                    for k in range(0, len(line) - 2 * WINDOW + 1, 2):
                        machine.add_word(line[k : k + 2 * WINDOW], first)
                    continue
                if raw != last:
                    if not ready:
                        ready = True
                        if len(machine):
                            machine.make_automaton()
                    get, last = number.get, raw
                    met = list(machine.iter("".join([get(w, none) for w in raw.split()]))) if len(machine) else []
                begin = end = -2
                for e, lo in met:
                    if lo >= first:
                        continue
                    e >>= 1
                    if e != end + 1:
                        if end >= 0:
                            out.append((h1, h2, start + begin, start + end + 1))
                        begin = e - WINDOW + 1
                    end = e
                if end >= 0:
                    out.append((h1, h2, start + begin, start + end + 1))
            yield _rows([[x[k] for x in out] for k in range(4)], [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["h1", "h2", "start", "stop"])

    return rows.repartition("shard").sortWithinPartitions("shard", "kind", "words").mapInArrow(run, "h1 long, h2 long, start int, stop int")


def repeats(distinct: DataFrame, work: Workspace) -> DataFrame:
    """(h1, h2, spans): for each text that has any, the stretches of words [start, stop) that an earlier document has; they may overlap."""
    stretch = stretches(distinct, work)
    phrase = phrases(stretch, work)
    shards = Shards(phrase, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hits = located(patterns(phrase, stretch, shards).union(searched(stretch, shards)))
    found = hits.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return work.save(found, "spans")


def kept_words(distinct: DataFrame, spans: DataFrame, whole: bool) -> DataFrame:
    """(h1, h2, first, n_words, n_removed, all_kept, kept): of the text's least id. kept is text if whole, else its sha256; all_kept likewise, of all words."""
    told = (lambda x: x.decode()) if whole else (lambda x: hashlib.sha256(x).hexdigest())

    def run(batches):
        for batch in batches:
            out = []
            for h1, h2, first, raw, found in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                words = raw.split()
                gone = np.zeros(len(words), bool)
                for s in found or ():
                    gone[s["start"] : s["stop"]] = True
                out.append((h1, h2, first, len(words), int(gone.sum()), told(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if found else b" ".join(words))))
            yield _rows([[x[k] for x in out] for k in range(6)], [*[pa.int64()] * 5, pa.string()], ["h1", "h2", "first", "n_words", "n_removed", "kept"])

    rows = distinct.join(spans, ["h1", "h2"], "left").select("h1", "h2", "first", F.encode("text", "UTF-8").alias("raw"), "spans")
    return rows.mapInArrow(run, "h1 long, h2 long, first long, n_words long, n_removed long, kept string")


def _kept(docs: DataFrame, work: Workspace, key: str, text: str, whole: bool) -> DataFrame:
    with shuffles_dropped(work.spark):
        distinct = texts(docs, work, key, text)
        return work.save(kept_words(distinct, repeats(distinct, work), whole), "kept")


def removed_repeats(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row of docs; other columns aren't read.

    A null text has no words. A null id counts as greater than any; ids need not be unique, and rows of one id take nothing from each other. Equal rows get equal results. No rows give no rows.
    """
    rows = _marked(docs, key, text).select("h1", "h2", "id").join(_kept(docs, work, key, text, whole=False), ["h1", "h2"])
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    gone, rest = F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")), F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.col("kept"))
    return rows.select(F.when(F.col("id") != LAST, F.col("id")).alias(key), "n_words", gone.alias("n_removed"), rest.alias("kept_sha256"))


def drop_repeats(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all columns, the text without the words that earlier documents have; words that stay are joined by one space, a text that loses none stays as it is.

    Documents that lose all words keep an empty text. Nulls and equal ids as in removed_repeats.
    """
    kept = _kept(docs, work, key, text, whole=True).filter((F.col("n_words") >= WINDOW)).select("h1", "h2", "first", F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept"))
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _marked(docs.withColumn("_row", given), key, text, [F.col("_row")]).drop("text").join(kept, ["h1", "h2"], "left")
    new = F.when(F.col("id") > F.col("first"), F.lit("")).otherwise(F.coalesce("kept", F.col(f"_row.`{text}`")))
    return rows.select(*[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "phrases"))


OP12_SQL = """
    WITH split AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    windows AS MATERIALIZED (SELECT r, id, i, array_to_string(w[i : i + 12], ' ') AS p FROM (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, w, unnest(range(1, len(w) - 11)) AS i FROM split)),
    hit AS (SELECT r, i FROM (SELECT r, i, id, min(id) OVER (PARTITION BY p) AS lo FROM windows) WHERE lo < id),
    gone AS MATERIALIZED (SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM hit) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
    sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(js, j))), ' ') END) AS kept_sha256
    FROM split LEFT JOIN gone USING (r)"""
