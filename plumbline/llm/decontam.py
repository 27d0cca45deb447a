"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed placeholders. Windows of WINDOW tokens, with
LITERALS of them at least that are no placeholders, meet the benchmark's by hash. What meets is grouped by document, item and diagonal
(the difference of places), and with it what meets on the SHIFT diagonals beside, so that words put in or taken out don't cut an item in two. Of that the best
chain is taken: windows whose places rise in both texts, and which cover most of the item's tokens. The slots that placeholders stand for are compared over the chain: in a
re-parameterised copy each value of the item has one value in the document. That is the value that most windows have for it, and windows with another one don't count.
A document leaks an item if the windows that agree so, or whose slots are all equal to the item's, hold CONTAINED of the item's tokens, or if RUN of them follow each other: 13 tokens in a row.
A gap of GAP tokens at most between windows, or of fewer than WINDOW at an end, is lost by half: an edit spoils the windows around it, not their words. Half of the tokens must be
covered whole.
Texts have windows in two forms: of all tokens, and with runs of names or of numbers as one placeholder, so that a value of more tokens ("twenty five" for "7") stays on the diagonal.

Items without such a window, as they are short or hold hardly any literals, are compared word for word instead: by windows of WINDOW tokens as they
are, or of all their tokens if they have fewer. An item of a single token leaks into a document that has no other.

An item that leaks has a number of windows in the chain, so at least one of its rarest ones, those beyond that number, is there: documents
and items meet by these, and only those that met are compared window by window. Windows that very many items share bring no pairs of their own.
Documents' windows that no window of the benchmark can equal are dropped where they arise, by a Bloom filter; the joins are by the windows' 64-bit
hashes and both sides are shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm import _bytes as B
from plumbline.llm._store import Workspace

WINDOW, LITERALS, CONTAINED, RUN = 5, 2, 0.8, 9
SHIFT, GAP = 4, WINDOW + 1
#: Forms of windows: of all tokens, of merged tokens, of WINDOW words, of 1 to WINDOW - 1 words (PLAIN + n).
ALL, MERGED, PLAIN = 0, 1, 2
#: The Bloom filter has 2 ** bits bits, 1024 or more for each window of the benchmark within these bounds: 32 MB at most are broadcast, and a larger benchmark passes more.
FILTER_BITS = (20, 28)

LITERAL, NUMBER, NAME, UNIT = range(4)
# Words read as numbers, as units, and capitalised words that are no names.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
UNITS = (
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms "
    "pound pounds lb lbs oz ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups second seconds sec minute minutes min hour hours hr day days week weeks month months "
    "year years dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit mph kph watt watts volt volts byte bytes kb mb gb"
).split()
STARTERS = "a an and as at but by each every for from given he her his how i if in is it its let many my of on or our she so some that the their there these they this those to was we what when where which who why with you your".split()

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hashes(words: list[str]) -> np.ndarray:
    data = "".join(words).encode()
    at = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])])
    return B.stretch(B.sums(np.frombuffer(data, np.uint8)), at[:-1], at[1:])


_TABLES: dict[str, np.ndarray] = {}


def canonical(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(type and, for literals, word of each token as one hash; its slot value, 0 for literals; offsets of each text's tokens)."""
    if not _TABLES:
        _TABLES.update(number=_hashes(NUMBERS), unit=_hashes(UNITS), starter=_hashes(STARTERS))
    inside = _INSIDE[data]
    if len(data) > 2:  # a point or comma between digits is part of the number
        mark = (data[1:-1] == 44) | (data[1:-1] == 46)
        inside[1:-1] |= mark & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    start, end = B.runs(inside, at)
    of = np.searchsorted(start, at, "left")
    if not len(start):
        return np.empty(0, B.U), np.empty(0, np.int64), of
    low = B.fold_latin(data)
    word = B.stretch(B.sums(low), start, end)
    kind = np.zeros(len(start), np.uint8)
    after = data[np.minimum(start + 1, len(data) - 1)]
    capital = (data[start] >= 65) & (data[start] <= 90) | (data[start] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)  # A to Z and, in two bytes, \u00c0 to \u00de
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    kind[capital & (small[end] > small[start]) & ~np.isin(word, _TABLES["starter"])] = NAME
    kind[np.isin(word, _TABLES["unit"]) & ~capital] = UNIT
    kind[_DIGIT[data[start]] | np.isin(word, _TABLES["number"])] = NUMBER
    literal = kind == LITERAL
    token = np.where(literal, word, B.mix(kind.astype(B.U) + B.U(1)))
    return token, np.where(literal, 0, word.view(np.int64) | 1), of


def merged(token: np.ndarray, slot: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with each run of names, or of numbers, of a text as one token, whose slot is a hash of its words in order."""
    if not len(token):
        return token, slot, of
    lead = np.ones(len(token), bool)
    lead[1:] = (slot[1:] == 0) | (token[1:] != token[:-1]) | ~np.isin(token[1:], B.mix(np.array([NUMBER + 1, NAME + 1], B.U)))
    lead[of[of < len(token)]] = True
    first = np.flatnonzero(lead)
    upto = np.concatenate([[0], np.cumsum(lead)])
    at_run = (np.arange(len(token)) - first[upto[1:] - 1]).astype(B.U)
    value = np.add.reduceat(B.mix(slot.view(B.U) + at_run), first).view(np.int64) | 1
    return token[first], np.where(slot[first] == 0, 0, value), upto[of]


def windows(data: np.ndarray, at: np.ndarray, form: int = ALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash, slots (n, WINDOW)) of the windows of one form of a block of texts."""
    token, slot, of = canonical(data, at)
    width = WINDOW
    if form == MERGED:
        token, slot, of = merged(token, slot, of)
    if form >= PLAIN:
        token, slot = np.where(slot == 0, token, slot.view(B.U)) | B.U(1), np.zeros_like(slot)
        width = form - PLAIN or WINDOW
    n = np.maximum(np.diff(of) - width + 1, 0)
    if width == 1:
        n = (np.diff(of) == 1).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = of[row] + place
    h = np.full(len(first), form, B.U)
    for k in range(width):
        h = h * B.U(0x100000001B3) + (token[first + k] if len(first) else token[:0])
    h = B.mix(h)
    free = np.concatenate([[0], np.cumsum(slot == 0)])
    good = free[first + width] - free[first] >= (LITERALS if form < PLAIN else 0)
    row, place, h, first = row[good], place[good], h[good], first[good]
    slots = np.zeros((len(first), WINDOW), np.int64)
    if form < PLAIN and len(first):
        slots = slot[first[:, None] + np.arange(WINDOW)]
    return row, place, h, slots


def item_forms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The form of windows that each text, as an item, is compared by beside MERGED: ALL, or one of the plain ones if it has none of either; -1 without tokens."""
    tokens = np.diff(canonical(data, at)[2])
    has = np.isin(np.arange(len(at) - 1), np.concatenate([windows(data, at, f)[0] for f in (ALL, MERGED)]))
    return np.where(has, ALL, np.where(tokens >= WINDOW, PLAIN, np.where(tokens > 0, PLAIN + tokens, -1)))


def _window_table(df: DataFrame, keep: list[str], forms: list[int] | None = None, filter_: np.ndarray | None = None) -> DataFrame:
    """df's columns keep, and form, place, h, slots of each window of its text: of the given forms that pass the filter or, for items, of the forms that they are compared by."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in B.blocks(batch.column(len(keep))):
                mine = item_forms(data, at) if forms is None else None
                for form in forms or sorted({ALL, MERGED, *mine.tolist()} - {-1}):
                    row, place, h, slots = windows(data, at, form)
                    if forms is None:
                        hit = (mine[row] == form) | (form == MERGED) & (mine[row] == ALL)
                    else:
                        spot = h >> B.U(65 - (len(filter_) << 6).bit_length())
                        hit = (filter_[(spot >> B.U(6)).astype(np.int64)] >> (spot & B.U(63)) & B.U(1)).astype(bool)
                    row, place, h, slots = row[hit], place[hit], h[hit], slots[hit]
                    if len(row):
                        at_row = pa.array(row + lo)
                        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at_row) for k in range(len(keep))], pa.array(np.full(len(row), form, np.int32)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(slots.ravel()), WINDOW).cast(pa.list_(pa.int64()))], [*keep, "form", "place", "h", "slots"])

    source = df.select(*keep, "text")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], "form int, place int, h long, slots array<long>"])
    return source.mapInArrow(run, schema)


def _filter(bench: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of the hashes of n windows, as 64-bit words: a hash's first bits name its bit. It comes to the driver as words that aren't zero."""
    bits = min(max((1024 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    spot = F.shiftrightunsigned("h", 64 - bits)
    rows = bench.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, B.U)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(B.U)
    return out


def chain(met: list[tuple[int, int]], width: int) -> list[int]:
    """Of (place, shift), the numbers of those that form the best chain: places, and places plus shifts, rise, and windows of that width cover most tokens. Of equal ones that with
    the fewest changes of shift, then the most windows."""
    order = sorted(range(len(met)), key=lambda k: met[k])
    value, before, last = {}, {}, {}  # last: of each shift, those taken so far; the newest that can precede is the best of it
    for k in order:
        p, s = met[k]
        value[k], before[k] = (width, 0, 1), None
        for t, taken in last.items():
            for j in reversed(taken):
                gap = p - met[j][0]
                if gap > 0 and gap + s - t > 0:
                    cover, changes, n = value[j]
                    v = (cover + min(width, gap), changes - (s != t), n + 1)
                    if v > value[k] or v == value[k] and before[k] is not None and met[j] < met[before[k]]:
                        value[k], before[k] = v, j
                    break
        last.setdefault(s, []).append(k)
    out, k = [], max(order, key=lambda k: value[k], default=None)
    while k is not None:
        out.append(k)
        k = before[k]
    return out[::-1]


def held(places: list[int], width: int, ends: tuple[int, int], tokens: int) -> tuple[float, int]:
    """(share of an item's tokens that windows at these rising places hold, tokens that they cover). ends: the item's first place and the end of its last window; tokens: those in its windows."""
    covered = sum(min(width, b - a) for a, b in zip(places, places[1:])) + width
    half = sum((b - a - width) // 2 for a, b in zip(places, places[1:]) if 0 < b - a - width <= GAP)
    half += sum(g // 2 for g in (places[0] - ends[0], ends[1] - places[-1] - width) if g < WINDOW)
    return round(min(1.0, (covered + half) / tokens), 6), covered


def judge(found: list[dict], width: int, ends: tuple[int, int], tokens: int) -> tuple[float, int, bool] | None:
    """(containment, windows that agree, whether all their slots are equal) of the better reading of what met of an item in a document, or None if it is no leak. found: place, shift, own and theirs (slots)."""
    line = [found[k] for k in chain([(w["place"], w["shift"]) for w in found], width)]
    pairs = [[(a, b) for a, b in zip(w["own"], w["theirs"]) if a] for w in line]
    most: dict[int, tuple[int, bool, int]] = {}
    for (a, b), n in Counter(x for w in pairs for x in w).items():
        most[a] = max(most.get(a, (0, False, 0)), (n, a == b, b))
    equal = [all(a == b for a, b in w) for w in pairs]
    agree = [all(most[a][2] == b for a, b in w) for w in pairs]
    best = None
    for take, exact in ((equal, True), (agree, not any(g and not e for g, e in zip(agree, equal)))):
        kept = [w for w, t in zip(line, take) if t]
        if not kept:
            continue
        share, covered = held([w["place"] for w in kept], width, ends, tokens)
        run = longest = 1
        for a, b in zip(kept, kept[1:]):
            run = run + 1 if b["place"] - a["place"] == 1 and b["shift"] == a["shift"] else 1
            longest = max(longest, run)
        if share >= CONTAINED and 2 * covered >= tokens or longest >= RUN:
            best = max(best or (0.0, 0, False), (share, len(kept), exact))
    return best


def _judged(line: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and what judge() says of each row that is a leak. line: keep, form, first, end, item_tokens, w."""

    def run(batches):
        for batch in batches:
            n, at, out = len(keep), [], []
            for k, (form, first, end, tokens, found) in enumerate(zip(*[batch.column(n + j).to_pylist() for j in range(5)])):
                width = form - PLAIN or WINDOW if form >= PLAIN else WINDOW
                if best := judge(found, width, (first, end), tokens):
                    at.append(k)
                    out.append(best)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(rows) for j in range(n)], *[pa.array([x[j] for x in out], t) for j, t in enumerate((pa.float64(), pa.int64(), pa.bool_()))]], [*keep, "containment", "matched", "exact"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in line.select(*keep).schema.fields)
    return line.select(*keep, "form", "first", "end", "item_tokens", "w").mapInArrow(run, f"{shape}, containment double, matched long, exact boolean")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tx, item_id, matched, item_windows, containment, kind) of each item that a document leaks; tx is xxhash64 of its text.

    kind is exact if all slots of the matched windows are equal, else reparameterised; matched counts those that agree, containment is the share of the item's tokens that they hold. Empty and
    null texts have no tokens and leak nothing. Items that repeat an item_id are one item by that id, and a document leaks it by any of its
    texts. Rows that repeat key and text are one document here. An empty table on either side gives no rows. Other columns aren't read.
    """
    work = Workspace(docs.sparkSession, "leaks")
    item = ["item_id", "ix", "form"]
    bench = work.save(_window_table(benchmark.select("item_id", F.xxhash64("text").alias("ix"), "text").distinct(), ["item_id", "ix"]), "items")
    forms = {r["form"]: r["n"] for r in bench.groupBy("form").agg(F.count("*").alias("n")).collect()}  # a row for each form
    mine = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tx"), F.col(text).alias("text"))
    hits = work.save(_window_table(mine, ["id", "tx"], sorted(forms) or [ALL], _filter(bench, sum(forms.values()))), "hits")
    width = F.when(F.col("form") > PLAIN, F.col("form") - PLAIN).otherwise(F.lit(WINDOW))
    step = F.least(width, F.coalesce(F.lead("place").over(W.partitionBy(*item).orderBy("place")) - F.col("place"), width))
    size = bench.withColumn("_step", step).groupBy(*item).agg(F.count("*").alias("item_windows"), F.sum("_step").alias("item_tokens"), F.min("place").alias("first"), F.max(F.col("place") + width).alias("end"))
    common = bench.groupBy("h").agg(F.count("*").alias("common"))
    need = F.least(F.ceil(F.ceil(F.col("item_tokens") / 2) / width), F.lit(RUN))
    rank = F.row_number().over(W.partitionBy(*item).orderBy("common", "h", "place"))
    rare = bench.join(common, "h").join(size, item).withColumn("rank", rank).filter(F.col("rank") <= F.col("item_windows") - need + 1).select(*item, "place", "h")
    pair = hits.select("id", "tx", F.col("place").alias("there"), "h").join(rare, "h").select("id", "tx", *item, (F.col("there") - F.col("place")).alias("diagonal")).distinct()
    own = pair.join(bench, item).withColumn("shift", F.explode(F.sequence(F.lit(-SHIFT), F.lit(SHIFT)))).withColumn("there", F.col("diagonal") + F.col("place") + F.col("shift"))
    theirs = hits.select(F.col("id").alias("i"), F.col("tx").alias("t"), F.col("place").alias("at"), F.col("h").alias("g"), F.col("slots").alias("theirs"))
    met = own.join(theirs, F.col("id").eqNullSafe(F.col("i")) & (F.col("tx") == F.col("t")) & (F.col("there") == F.col("at")) & (F.col("h") == F.col("g")))
    keys = ["id", "tx", *item, "diagonal"]
    line = met.groupBy(*keys).agg(F.collect_set(F.struct("place", "shift", F.col("slots").alias("own"), "theirs")).alias("w")).join(size, item)
    leaks = _judged(line.filter(F.size(F.array_distinct("w.place")) >= need), ["id", "tx", "item_id", "item_windows"])
    best = leaks.groupBy("id", "tx", "item_id").agg(F.max(F.struct("containment", "matched", "exact", "item_windows")).alias("b"))
    return best.select(F.col("id").alias(key), "tx", "item_id", "b.matched", "b.item_windows", "b.containment", F.when(F.col("b.exact"), F.lit("exact")).otherwise(F.lit("reparameterised")).alias("kind"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that leak no item. Columns stay as they are, whatever their names; documents without windows stay."""
    names = docs.columns
    bad = find_leaks(docs.select(F.col(key), F.col(text)), benchmark, key, text).select(F.col(key).alias("id"), "tx").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("tx"))
    kept = row.alias("d").join(bad.alias("b"), F.col("d.id").eqNullSafe(F.col("b.id")) & (F.col("d.tx") == F.col("b.tx")), "left_anti")
    return kept.select(*[F.col(f"r.`{c}`").alias(c) for c in names])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: doc_id, item_id, matched, item_windows, containment, kind."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, bench).select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("item_windows").cast("long").alias("item_windows"), "containment", "kind")
