"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its first and last one to three bytes, its byte trigrams and the whole word (the lexicon), hashed into
FEATURES rows of weights; a matrix of weights between the labels of neighbouring words is learned with them. Labels of words are
read off by forward-backward, exactly and over whole texts: products of the step matrices of blocks of words are
formed first, then messages pass from block to block and inside the blocks, all blocks of a batch at once.
A text's language is that of the most of its letters, by the words' posteriors; word_labels() gives the stretches of words of each.

Learning takes a bounded sample of labelled texts, whole ones, with about the same number of each language, spliced into sequences
that switch language, so that the transitions of code-switched text are learned. Posteriors of the learned languages always add up to one, so
to tell texts in none of them a field has one label more, that of no language: it is learned from the same texts with their words' letters shuffled, drawn by
pairs of letters, or drawn from other alphabets. Forward-backward then gives each word a posterior for it.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _bytes as B
from plumbline.llm.quality import held_out

FEATURES, SPAN = 1 << 15, 32
#: The bound of the sample that is learned from, in texts.
MAX_TEXTS = 800
#: A text is in no learned language if more than this share of its letters' posterior is for none; more than all but QUANTILE of the texts learned from have, in any case.
FOREIGN, QUANTILE = 0.55, 0.002
UNKNOWN = "und"
#: Words that the label of no language is learned from, at least, if there are any.
NONE_WORDS = 2000
#: Values that one step of learning has in hand at once.
PART = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of weights (words, 7), rows of weights of trigrams, offsets of each word's trigrams, letters of each word, offsets of each text's words)."""
    start, end = B.runs(_LETTER[data], at)
    low = B.fold_latin(data)
    total = B.sums(low)
    kinds = [(start, np.minimum(start + k, end)) for k in (1, 2, 3)] + [(np.maximum(end - k, start), end) for k in (1, 2, 3)] + [(start, end)]
    rows = np.stack([(B.mix(B.stretch(total, a, b) + B.U(i)) % B.U(FEATURES)).astype(np.int32) for i, (a, b) in enumerate(kinds)], axis=1) if len(start) else np.empty((0, 7), np.int32)
    n = np.maximum(end - start - 2, 0)
    of = np.concatenate([[0], np.cumsum(n)])
    pos = np.repeat(start - of[:-1], n) + np.arange(of[-1])
    wide = low.astype(np.uint32)
    tri = wide[pos] | wide[pos + 1] << np.uint32(8) | wide[pos + 2] << np.uint32(16) if len(pos) else np.empty(0, np.uint32)
    tri = ((tri * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)  # 15 bits
    return rows, tri, of, end - start, np.searchsorted(start, at, "left")


def _emissions(rows: np.ndarray, tri: np.ndarray, of: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[rows].sum(axis=1) + B.tail(weights[tri], of)


def _has_letter(data: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; words has the offsets of the texts' words."""
    has = np.diff(words) > 0
    plain = np.concatenate([[0], np.cumsum(_ASCII[data])])
    for i in np.flatnonzero(has & (plain[at[1:]] == plain[at[:-1]])):  # no ASCII letter: look at the characters
        has[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


class Field:
    """The field: languages, weights (FEATURES, labels), moves between labels (before, after). Labels are the languages and, if asked for, none of them."""

    def __init__(self, languages: list[str], none: bool = False):
        self.languages = languages
        self.none = none and bool(languages)
        labels = len(languages) + self.none
        self.weights = np.zeros((FEATURES, labels), np.float32)
        self.moves = np.zeros((labels, labels), np.float32)
        self.most = 1.0  # share of none above which a text is in none of the languages

    def fit(self, texts: list[str], truth: np.ndarray, epochs: int = 24, length: int = 48, rate: float = 0.3) -> "Field":
        """Maximises the likelihood of spliced sequences by Adagrad, with a fixed seed."""
        k = len(self.moves)
        if k < 2:
            return self
        given = pa.array(texts, pa.string())
        if self.none:
            odd = no_language(texts, -(-len(texts) // len(self.languages)))
            texts, truth = [*texts, *odd], np.append(truth, np.full(len(odd), k - 1))
        array = pa.array(texts, pa.string())
        rng = np.random.default_rng(11)
        parts = [word_features(data, at) for _, _, data, at in B.blocks(array)]
        rows = np.concatenate([p[0] for p in parts])
        tri = np.concatenate([p[1] for p in parts])
        of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        words = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[4]) for p in parts]))])
        label = np.repeat(truth, np.diff(words))
        if not len(label):
            return self
        # sequences: the words in the seeded order of pieces of 3 to 24 words, cut every length words
        cuts = [np.arange(lo, hi) for a, b in zip(words, words[1:]) for lo, hi in _pieces(a, b, rng)]
        line = np.concatenate([cuts[i] for i in rng.permutation(len(cuts))])
        line = np.resize(line, -(-len(line) // length) * length).reshape(-1, length)
        size = np.diff(of)
        g2w, g2m = np.full(self.weights.shape, 1e-2, np.float32), np.full(self.moves.shape, 1e-2, np.float32)
        flat = np.concatenate([rows.ravel(), tri])
        number = np.arange(len(rows), dtype=np.int32)
        word = np.concatenate([np.repeat(number, rows.shape[1]), np.repeat(number, size)])
        uses = np.bincount(line.ravel(), minlength=len(rows)).astype(np.float32)
        pair = np.zeros((k, k), np.float32)
        np.add.at(pair, (label[line[:, :-1]].ravel(), label[line[:, 1:]].ravel()), 1)
        one = np.eye(k, dtype=np.float32)[label] * uses[:, None]
        for _ in range(epochs):
            slope, move = slopes(_emissions(rows, tri, of, self.weights), self.moves, line, one, pair)
            grad = 1e-5 * self.weights
            for lo in range(0, len(flat), PART):
                at, of_word = flat[lo : lo + PART], word[lo : lo + PART]
                grad += np.stack([np.bincount(at, weights=slope[of_word, j], minlength=FEATURES) for j in range(k)], axis=1).astype(np.float32)
            g2w += grad * grad
            g2m += move * move
            self.weights -= rate * grad / np.sqrt(g2w)
            self.moves -= rate * move / np.sqrt(g2m)
        if self.none:
            self.most = max(FOREIGN, float(np.quantile(self.foreign(given), 1 - QUANTILE)))
        return self

    def letters(self, texts: pa.Array) -> np.ndarray:
        """Whether each text has a letter."""
        out = np.zeros(len(texts), bool)
        for lo, hi, data, at in B.blocks(texts):
            out[lo:hi] = _has_letter(data, at, np.searchsorted(B.runs(_LETTER[data], at)[0], at, "left"))
        return out

    def _mass(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letters' posteriors of each label, offsets of each text's words) of a block of texts."""
        rows, tri, of, letters, words = word_features(data, at)
        post = posterior(_emissions(rows, tri, of, self.weights), words, self.moves)
        return B.tail(post * letters[:, None], words) if len(rows) else np.zeros((len(at) - 1, len(self.moves))), words

    def foreign(self, texts: pa.Array) -> np.ndarray:
        """The share of each whole text's letters' posterior that is for none of the languages; 0 for a text without a letter."""
        out = np.zeros(len(texts))
        for lo, hi, data, at in B.blocks(texts):
            mass, _ = self._mass(data, at)
            if self.none:
                out[lo:hi] = mass[:, -1] / np.maximum(mass.sum(axis=1), 1e-9)
        return out

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language's number or -1, share of the letters' posterior) of each whole text."""
        best, share = np.full(len(texts), -1), np.zeros(len(texts))
        k = len(self.languages)
        for lo, hi, data, at in B.blocks(texts):
            mass, words = self._mass(data, at)
            mass = mass[:, :k]
            has = _has_letter(data, at, words)
            if k:
                best[lo:hi] = np.where(has, mass.argmax(axis=1), -1)
                share[lo:hi] = np.where(has, mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1e-9), 0)
        return best, np.clip(share, 0, 1)

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first character, character after the last, language's number, mean posterior) of each stretch of words with one label."""
        out = []
        for lo, _, data, at in B.blocks(texts):
            start, end = B.runs(_LETTER[data], at)
            if not len(start) or not self.languages:
                continue
            rows, tri, of, _, words = word_features(data, at)
            post = posterior(_emissions(rows, tri, of, self.weights), words, self.moves)
            label, text = post.argmax(axis=1), B.owner(at, start)
            first = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])]))
            last = np.append(first[1:], len(label)) - 1
            char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
            base = char[at[text[first]]]
            mean = np.add.reduceat(post.max(axis=1).astype(np.float64), first) / (last - first + 1)
            out.append((text[first] + lo, char[start[first]] - base, char[end[last]] - base, label[first], mean))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64))


def no_language(texts: list[str], n: int) -> list[str]:
    """n texts in no language, made from texts with a fixed seed: of their words, a third each has its letters shuffled, is drawn letter by letter after the letters that follow each
    other in all the texts, and is drawn from letters of some other alphabet."""
    rng = random.Random(7)
    # ranges of letters: Latin beyond ASCII, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Kana, Han, Hangul
    alphabets = [(0x61, 0x7B), (0xDF, 0xF7), (0x100, 0x180), (0x3B1, 0x3CA), (0x430, 0x450), (0x5D0, 0x5EB), (0x627, 0x64B), (0x905, 0x93A), (0x3041, 0x3097), (0x4E00, 0x5A00), (0xAC00, 0xB800)]
    follow: dict[str, list[str]] = {}
    for text in texts:
        for w in text.split()[:400]:
            for a, b in zip(f" {w}", f"{w} "):
                follow.setdefault(a, []).append(b)

    def drawn(size: int) -> str:
        out, now = "", " "
        while len(out) < 2 * size + 2:
            now = rng.choice(follow[now])
            if now == " ":
                break
            out += now
        return out

    def odd(word: str) -> str:
        kind = rng.randrange(3)
        if kind == 0:
            return "".join(rng.sample(word, len(word)))
        if kind == 1:
            return drawn(len(word))
        lo, hi = rng.choice(alphabets)
        return "".join(chr(rng.randrange(lo, hi)) for _ in word)

    some = sorted(texts, key=len)[:: max(1, len(texts) // max(1, n))][:n]
    # of few words, each is made several times over, so that enough letters are met
    times = max(1, NONE_WORDS // max(1, sum(len(t.split()) for t in some)))
    return [" ".join(odd(w) for _ in range(times) for w in t.split()) for t in some]


def slopes(e: np.ndarray, moves: np.ndarray, line: np.ndarray, one: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the mean negative log-likelihood of sequences, by the emissions e of words and by moves. line: the words of each sequence; one: how often each word
    stands in them, at its label; pair: how often each label follows another."""
    expected, pairs = np.zeros(e.shape), np.zeros(moves.shape)
    for lo in range(0, len(line), PART // line.shape[1]):
        some = line[lo : lo + PART // line.shape[1]]
        post, n = _posterior_dense(e[some], moves)
        pairs += n
        for j in range(e.shape[1]):
            expected[:, j] += np.bincount(some.ravel(), weights=post[:, :, j].ravel(), minlength=len(e))
    return (expected - one) / len(line), (pairs - pair) / len(line)


def _pieces(a: int, b: int, rng: np.random.Generator):
    while a < b:
        n = int(rng.integers(3, 25))
        yield a, min(a + n, b)
        a += n


def _posterior_dense(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequences, length, labels) and expected counts of moves, of sequences of equal length."""
    n, length, k = e.shape
    x, m = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
    fore, back = np.empty_like(x), np.ones_like(x)
    fore[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        v = (fore[:, t - 1] @ m) * x[:, t]
        fore[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        v = (x[:, t + 1] * back[:, t + 1]) @ m.T
        back[:, t] = v / v.sum(axis=1, keepdims=True)
    post = fore * back
    post /= post.sum(axis=2, keepdims=True)
    pair = np.einsum("nti,ij,ntj->ntij", fore[:, :-1], m, x[:, 1:] * back[:, 1:])
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return post, pair.sum(axis=(0, 1))


def posterior(e: np.ndarray, words: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posteriors (words, labels) by exact forward-backward in each text; words has the offsets of the texts' words."""
    n, k = e.shape
    if not n or not k:
        return np.zeros((n, k), np.float32)
    x = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    m = np.exp(moves - moves.max()).astype(np.float32)
    count = np.diff(words)
    per = -(-count // SPAN)  # blocks of each text
    first = np.concatenate([[0], np.cumsum(per)])
    blocks = int(first[-1])
    text = np.repeat(np.arange(len(count)), per)
    nth = np.arange(blocks) - first[text]
    begin = words[text] + nth * SPAN
    size = np.minimum(words[text + 1] - begin, SPAN)
    spot = begin[:, None] + np.arange(SPAN)
    inside = np.arange(SPAN) < size[:, None]
    grid = np.where(inside[:, :, None], x[np.minimum(spot, n - 1)], 1).astype(np.float32).transpose(1, 0, 2).copy()  # (SPAN, blocks, k)
    inside = inside.T.copy()
    # the product of each block's steps; the first step of a text has no move before it
    opening = nth == 0
    p = np.tile(np.eye(k, dtype=np.float32), (blocks, 1, 1))
    for t in range(SPAN):
        q = p if t == 0 and opening.all() else (p.reshape(-1, k) @ m).reshape(blocks, k, k)
        if t == 0:
            q = np.where(opening[:, None, None], p, q)
        q = q * grid[t][:, None, :]
        q /= np.maximum(q.max(axis=(1, 2), keepdims=True), 1e-30)
        p = q if inside[t].all() else np.where(inside[t][:, None, None], q, p)
    # messages at the borders of blocks, text by text in step
    come, leave = np.ones((blocks, k), np.float32), np.ones((blocks, k), np.float32)
    depth = int(per.max())
    order = np.argsort(-per, kind="stable")
    live = np.searchsorted(-per[order], -np.arange(1, depth + 1), "right")  # texts that have a block of each number
    for b in range(depth - 1):
        at = first[order[: live[b + 1]]] + b
        v = np.einsum("bi,bij->bj", come[at], p[at])
        come[at + 1] = v / np.maximum(v.max(axis=1, keepdims=True), 1e-30)
    for b in range(depth - 1, 0, -1):
        at = first[order[: live[b]]] + b
        v = np.einsum("bij,bj->bi", p[at], leave[at])
        leave[at - 1] = v / np.maximum(v.max(axis=1, keepdims=True), 1e-30)
    # and inside the blocks
    fore = np.empty_like(grid)
    v = come
    for t in range(SPAN):
        moved = v @ m
        if t == 0:
            moved = np.where(opening[:, None], v, moved)
        u = moved * grid[t]
        u /= np.maximum(u.max(axis=1, keepdims=True), 1e-30)
        v = np.where(inside[t][:, None], u, v)
        fore[t] = v
    out = np.empty((n, k), np.float32)
    back = leave
    for t in range(SPAN - 1, -1, -1):
        on = inside[t]
        post = fore[t] * back
        out[spot[on, t]] = (post / np.maximum(post.sum(axis=1, keepdims=True), 1e-30))[on]
        u = (grid[t] * back) @ m.T
        u /= np.maximum(u.max(axis=1, keepdims=True), 1e-30)
        back = np.where(on[:, None], u, back)
    return out


def train(docs: DataFrame, max_texts: int = MAX_TEXTS, none: bool = False) -> Field:
    """Learns, with a label for no language if asked for, from about max_texts whole texts of documents that aren't held out and whose lang is known, chosen by a hash of id and text."""
    known = docs.select(F.col("doc_id").alias("id"), "text", "lang").filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return Field([])
    each = max(1, max_texts // (len(languages) + none))  # the texts for no language are within the bound too
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, each / counts[lang])))])
    some = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit("lang"), "id", F.xxhash64("text")), 11) < F.element_at(share, F.col("lang")) * float(1 << 53))
    rows = some.select("lang", "id", "text").collect()
    rows.sort(key=lambda r: (r["lang"], r["id"], r["text"]))
    return Field(languages, none).fit([r["text"] for r in rows], np.array([languages.index(r["lang"]) for r in rows], np.int64))


def predict(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) of each whole text; UNKNOWN and 0 for a null text, one without a letter, or a field without languages."""
    kind = docs.schema[key].dataType
    names = np.array([*field.languages, UNKNOWN], object)

    def run(batches):
        for batch in batches:
            best, share = field.read(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(np.round(share.astype(np.float64), 6))], ["id", "held_out", "lang_pred", "score"])

    out = docs.select(F.col(key).alias("id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", key)


def word_labels(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, lang, score): the stretches of words with one label in each whole text, by characters from 0, end exclusive, and the mean posterior of its words.

    A null text, or one without a letter, has none. Rows that repeat give theirs as often. No rows, or a field without languages, give no rows.
    """
    kind = docs.schema[key].dataType
    names = np.array([*field.languages, UNKNOWN], object)

    def run(batches):
        for batch in batches:
            row, start, end, label, score = field.spans(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end), pa.array(names[label], pa.string()), pa.array(np.round(score, 6))], ["id", "start", "end", "lang", "score"])

    out = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, start long, end long, lang string, score double")
    return out.withColumnRenamed("id", key)


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for all docs by a field learned from them. Repeated rows are predicted alike, each in its own row; an empty table gives
    no rows; columns other than doc_id, text and lang aren't read."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents of docs that have a letter, and whose letters are for no more than the field's share in none of the learned languages. Columns stay as they are, whatever their names.

    Null, empty and letterless texts go; texts in several of the languages stay. Rows that repeat share a verdict. Where no document has a known lang nothing is learned, and all that have a letter
    stay; an empty table gives an empty one.
    """
    field = field or train(docs.select("doc_id", "text", "lang"), none=True)
    names = docs.columns
    row = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = names.index("text")

    def run(batches):
        for batch in batches:
            kept = field.letters(batch.column(text)) & (field.foreign(batch.column(text)) <= field.most)
            yield batch.filter(pa.array(kept))

    out = row.mapInArrow(run, row.schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
