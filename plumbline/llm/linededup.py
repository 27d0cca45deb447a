"""Line dedup across documents, exact and within one edit, by a deletion-neighbourhood join; built-in functions only.

A line is dropped where an earlier line, by document and then by place, is equal or within one edit (a character
put in, taken out or replaced) of it. Blank lines part paragraphs: they are no lines here, and stay. Three steps:

1. Equal lines meet by a 128-bit hash; each distinct line knows where it first stands.
2. Of three thirds of the shorter of two lines within one edit, the edit leaves two: the first two, the last two, or the first and
   the last. Distinct lines meet by hashes of those three pairs, and only those that meet another go on.
3. Those emit the hash of every variant with one character taken out, and of the whole. Two lines whose variants at
   the same place are equal differ by a replacement there; a line that equals another's variant lacks one
   character of it. So the earliest of a bucket is a partner, and no pairs within a bucket are formed: distinct
   lines with one variant at one place are no more than characters of the alphabet. Each pair is verified
   by taking out the character at the place where its variants met: n steps, where levenshtein() takes n * n.

The hash of a line with one character taken out comes from running exclusive ors over its characters, which can't overflow, so a line of n
characters costs n steps, however long it is. Lines are cut in pieces of PIECE characters, whose sums are joined up first: a long
line is many tasks' work.

The texts of step 3 are read again from the documents. A table of bits, of one size for all inputs, tells where a line may be one of
those, so that the others are not shuffled; those that pass are joined by document and place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._store import Workspace

MIN_CHARS = 1  # a parameter: lines of fewer characters, trimmed, stay. At 1 that is blank lines alone
PIECE = 4096  # characters of a line that one window takes
MARK_BINS, MARK_WORDS = 16384, 64  # bits that tell where a suspect may be: rows, and words of 64 bits in each, 8 MB in all. Few bits let more lines through, none is lost


def identity(line: Column) -> list[Column]:
    """Two hashes of a line, 128 bits: the second starts from another seed. (A number after the line would only hash the first hash again.)"""
    return [F.xxhash64(line), F.xxhash64(F.lit(7), line)]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, tx, ln, line: the lines, trimmed, that can be dropped. docs: doc, tx, text."""
    out = docs.select("doc", "tx", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    return out.withColumn("line", F.btrim("line", F.lit(" \t\r\f\x0b"))).filter(F.length("line") >= max(1, min_chars))


def _third_keys(line: Column) -> Column:
    """Hashes of the pairs of thirds, for the line as the shorter and, where thirds are others then, as the longer of a pair."""
    n = F.length(line)

    def keys(t: Column) -> list[Column]:
        first, last = F.substring(line, F.lit(1), t), F.right(line, t)
        return [F.xxhash64(F.lit(1), t, F.substring(line, F.lit(1), t * 2)), F.xxhash64(F.lit(2), t, F.right(line, t * 2)), F.xxhash64(F.lit(3), t, first, last)]

    short, long = F.floor((n - 1) / 3).cast("int"), F.greatest(F.floor((n - 2) / 3).cast("int"), F.lit(0))
    return F.when(short == long, F.array(*keys(short))).otherwise(F.array(*keys(short), *keys(long)))


def _suspects(distinct: DataFrame, work: Workspace) -> DataFrame:
    """(h1, h2, first, doc, tx, ln) of the distinct lines that share two thirds with another."""
    key = distinct.select("h1", "h2", "first", F.explode("keys").alias("key"))
    met = key.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("key")
    out = key.join(work.save(met, "met"), "key").select("h1", "h2", "first").distinct()
    return work.save(out.select("h1", "h2", "first", F.col("first.doc").alias("doc"), F.col("first.tx").alias("tx"), F.col("first.ln").alias("ln")), "suspects")


def _marked(lines: DataFrame, suspects: DataFrame) -> DataFrame:
    """The rows of lines that may be suspects by document and place: all that are, and of the others those that share a bit with one."""
    width = MARK_WORDS * 64
    slot = F.pmod(F.xxhash64("doc", "tx", "ln"), F.lit(MARK_BINS * width))
    places = [F.floor(slot / width).cast("int").alias("bin"), (slot % width).cast("int").alias("at")]
    marks = _bits(suspects.select(*places), ("bin",), "at", MARK_WORDS).select("bin", "words")
    return lines.select("*", *places).join(F.broadcast(marks), "bin").filter(_dropped(F.col("words"), F.col("at"))).select(*lines.columns)


def _variants(held: DataFrame, work: Workspace) -> DataFrame:
    """(h1, h2, first, place, v1, v2): the hash of each line of held without the character at each place from 0, and whole at place -1."""
    z = lambda at, c, salt: F.xxhash64(F.lit(salt), at, c)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("line") - 1) / PIECE).cast("int")), lambda p: F.substring(F.col("line"), p * PIECE + 1, F.lit(PIECE)))
    pieces = held.select("h1", "h2", "first", F.posexplode(cut).alias("p", "piece"))
    # a character before the one taken out keeps its place, and one after it moves up by one: sums a and b
    moved = {"a": 0, "b": 1}
    chars = F.slice(F.split("piece", ""), F.lit(1), F.length("piece"))
    total = lambda n, salt: F.aggregate(F.transform(chars, lambda c, i: z(F.col("p") * PIECE + i - moved[n], c, salt)), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    sums = pieces.select("h1", "h2", "first", "p", *[total(n, s).alias(f"{n}{s}") for n in "ab" for s in (1, 2)])
    line = W.partitionBy("h1", "h2").orderBy("p")
    before, after, all_ = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing), W.partitionBy("h1", "h2")
    none = F.lit(0).cast("long")
    edges = sums.select(
        "h1", "h2", "first", "p",
        *[F.coalesce(F.bit_xor(f"a{s}").over(before), none).alias(f"before{s}") for s in (1, 2)],
        *[F.coalesce(F.bit_xor(f"b{s}").over(after), none).alias(f"after{s}") for s in (1, 2)],
        *[F.bit_xor(f"a{s}").over(all_).alias(f"whole{s}") for s in (1, 2)],
    )
    edges = work.save(edges, "edges")
    # pieces are dealt out before they are taken apart, by a fixed number of partitions, so that their characters needn't be
    # (before the join, which keeps to it)
    dealt = pieces.repartition(int(work.spark.conf.get("spark.sql.shuffle.partitions")), "h1", "h2", "p").join(edges.drop("first"), ["h1", "h2", "p"])
    one = dealt.select("*", F.posexplode(chars).alias("i", "c")).drop("piece")
    own = W.partitionBy("h1", "h2", "p")
    left, right = own.orderBy("i").rowsBetween(W.unboundedPreceding, -1), own.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, -1)
    at = F.col("p") * PIECE + F.col("i")
    one = one.withColumns({f"l{s}": F.coalesce(F.bit_xor(z(at, F.col("c"), s)).over(left), none) for s in (1, 2)} | {f"r{s}": F.coalesce(F.bit_xor(z(at - 1, F.col("c"), s)).over(right), none) for s in (1, 2)})
    without = [reduce(Column.bitwiseXOR, [F.col(f"{n}{s}") for n in ("before", "l", "r", "after")]).alias(f"v{s}") for s in (1, 2)]
    whole = edges.filter("p = 0").select("h1", "h2", "first", F.lit(-1).alias("place"), F.col("whole1").alias("v1"), F.col("whole2").alias("v2"))
    return one.select("h1", "h2", "first", at.alias("place"), *without).unionByName(whole)


def _near(held: DataFrame, work: Workspace) -> DataFrame:
    """(h1, h2): the lines of held that an earlier one is within one edit of."""
    bucket, place = W.partitionBy("v1", "v2"), W.partitionBy("v1", "v2", "place")
    met = _variants(held, work).withColumns(
        {
            "same": F.min("first").over(place),
            "full": F.min(F.when(F.col("place") < 0, F.col("first"))).over(bucket),
            "less": F.min(F.when(F.col("place") >= 0, F.struct(F.col("first").alias("partner"), F.col("place").alias("at")))).over(bucket),
        }
    )
    earliest = F.when(F.col("place") < 0, F.col("less")).otherwise(F.struct(F.least("same", "full").alias("partner"), F.col("place").alias("at")))
    pairs = met.select("h1", "h2", "first", earliest.alias("e")).filter(F.col("e.partner") < F.col("first"))
    pairs = pairs.groupBy("h1", "h2", F.col("e.partner").alias("partner")).agg(F.min("e.at").alias("at"))
    texts = held.select(F.col("first").alias("partner"), F.col("line").alias("other"))
    near = pairs.join(held.select("h1", "h2", "line"), ["h1", "h2"]).alias("p").join(texts.alias("t"), F.col("p.partner").eqNullSafe(F.col("t.partner")))
    line, other = F.col("line"), F.col("other")
    cut = lambda x: F.concat(F.substring(x, F.lit(1), F.col("at")), F.substring(x, F.col("at") + 2, F.length(x)))
    return near.filter((cut(line) == cut(other)) | (cut(line) == other) | (line == cut(other))).select("h1", "h2").distinct()


def duplicate_lines(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, tx, ln): the lines to drop, by document, hash of its text, and place from 0. Rows that repeat give theirs as often.

    Null texts have no lines. A null key is a document that comes first; of documents with one key the hash of the text tells the order.
    """
    given = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("tx"), F.col(text).alias("text"))
    h = [c.alias(n) for c, n in zip(identity(F.col("line")), ("h1", "h2"))]
    occurrences = _lines(given, min_chars).select("doc", "tx", "ln", *h, _third_keys(F.col("line")).alias("keys"))
    distinct = work.save(
        occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc", "tx", "ln")).alias("first"), F.count("*").alias("n"), F.any_value("keys").alias("keys")), "distinct"
    )
    suspects = _suspects(distinct, work)
    on = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("doc", "tx", "ln")])
    # a document that repeats with equal text gives its lines twice
    held = _marked(_lines(given, min_chars), suspects).alias("l").join(suspects.alias("s"), on).select("s.h1", "s.h2", "s.first", "l.line").dropDuplicates(["h1", "h2"])
    near = _near(work.save(held, "held"), work).withColumn("near", F.lit(True))

    # an occurrence goes if it isn't the line's first, or if the line has an earlier partner
    # (written, so that the join has a plain side each and Spark can split the partition of a line that is everywhere)
    heads = work.save(distinct.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").filter("n > 1 OR near"), "heads")
    thin = _lines(given, min_chars).select("doc", "tx", "ln", *h)
    gone = thin.join(heads, ["h1", "h2"]).filter(F.coalesce("near", F.lit(False)) | ~F.struct("doc", "tx", "ln").eqNullSafe(F.col("first")))
    return gone.select("doc", "tx", "ln")


def _bits(gone: DataFrame, keys: tuple[str, ...] = ("doc", "tx"), at: str = "ln", least: int = 1) -> DataFrame:
    """(doc, tx, n_removed, words): for each document that loses lines, a bit for each of its lines, 64 to a word. Other keys and places likewise; least words at least."""
    word = gone.distinct().groupBy(*keys, F.floor(F.col(at) / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(at) % 64)).alias("bits"))
    per = word.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.sum(F.bit_count("bits")).alias("n_removed"), F.greatest(F.max("w"), F.lit(least - 1)).alias("top"))
    return per.select(*keys, "n_removed", F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))).alias("words"))


def _dropped(words: Column, i: Column) -> Column:
    """Whether the bit of line i is set; a word past the end has none."""
    word = F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftrightunsigned", word, i % 64).bitwiseAND(F.lit(1).cast("long")) == 1


def dedup_lines(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the dropped lines; a document of which nothing but blank lines is left by that goes.

    Blank lines, and lines of fewer than min_chars characters, trimmed, stay.
    Documents go by key, null first, and equal keys by a hash of the text; rows that repeat key and text are one document and share
    its verdict. A null text stays null and an empty one empty. Columns keep their names, order and other values, whatever they are
    called. An empty table gives an empty one.
    """
    bits = _bits(duplicate_lines(docs, work, key, text, min_chars))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("tx"))
    on = F.col("d.doc").eqNullSafe(F.col("b.doc")) & (F.col("d.tx") == F.col("b.tx"))
    both = row.alias("d").join(bits.alias("b"), on, "left")
    left = F.filter(F.split(F.col(f"r.`{text}`"), "\n", -1), lambda x, i: ~_dropped(F.col("words"), i))
    kept = F.when(F.col("words").isNull(), F.col(f"r.`{text}`")).otherwise(F.array_join(left, "\n"))
    out = both.withColumn("kept", kept).filter(F.col("words").isNull() | (F.btrim("kept", F.lit(" \t\r\n\f\x0b")) != ""))
    return out.select(*[F.col("kept").alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed: the places, from 0 and by commas, of the lines that go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = duplicate_lines(docs, Workspace(spark, "lines"))
    per = gone.distinct().groupBy("doc", "tx").agg(F.sort_array(F.collect_list("ln")).alias("removed"))
    base = docs.select("doc_id", F.xxhash64("text").alias("tx"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    out = base.alias("d").join(per.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc")) & (F.col("d.tx") == F.col("p.tx")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


#: Lines within one edit share a half of the shorter one; here they meet by that. levenshtein() counts bytes in DuckDB, so it only thins out the pairs (a character has four
#: bytes at most), and characters are compared then: two that differ in one place, or one taken out of the longer line.
OP5_SQL = """
WITH l AS (
  SELECT doc_id, ln - 1 AS ln, trim(line, E' \\t\\r\\f\\v') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
), o AS (SELECT * FROM l WHERE line <> ''),
u AS (SELECT line, length(line) AS n, min((doc_id, ln)) AS first FROM o GROUP BY line),
h AS (
  SELECT *, left(line, k) AS a, right(line, k) AS z FROM (SELECT line, first, n, unnest(list_distinct([n // 2, (n - 1) // 2])) AS k FROM u)
), p AS (
  SELECT DISTINCT x.line, y.line AS other, x.n, y.n AS k FROM h x JOIN h y ON x.k = y.k AND (x.a = y.a OR x.z = y.z) AND y.first < x.first AND abs(x.n - y.n) <= 1 AND levenshtein(x.line, y.line) <= 4
), m AS (
  SELECT DISTINCT line FROM p WHERE CASE WHEN n = k THEN len(list_filter(range(1, n + 1), lambda i: line[i] <> other[i])) <= 1
    WHEN n > k THEN len(list_filter(range(0, n), lambda i: left(line, i) || substr(line, i + 2) = other)) > 0 ELSE len(list_filter(range(0, k), lambda i: left(other, i) || substr(other, i + 2) = line)) > 0 END
), g AS (
  SELECT doc_id, ln FROM o JOIN u USING (line) WHERE (doc_id, ln) <> first OR line IN (SELECT line FROM m)
), r AS (SELECT doc_id, count(*) AS n, string_agg(ln::VARCHAR, ',' ORDER BY ln) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.removed, '') AS removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
