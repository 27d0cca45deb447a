"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, a temperature.

Random indexing: every word has a fixed sparse vector of +1 and -1, which its hash names; its word vector is the sum of the fixed
vectors of all its neighbours within WINDOW words, over all documents. Every word that is at least one in SHARE of all words has a
vector of its own; that is SHARE words at most, whatever the corpus. Rarer words share RARE vectors by hash. So the table has a bounded
size at every scale: each task sums its own, and tasks' sums are added by Spark. Words and runs of punctuation are
tokens. Long texts are taken in stretches, so a task's memory doesn't grow with them.

The network is fitted on the driver, on the pooled vectors of a bounded sample of labelled documents; all else covers
every document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _bytes as B
from plumbline.llm._store import Workspace

DIM, NONZERO, WINDOW = 32, 4, 2
#: Words that are one in SHARE of all words or more have vectors of their own, the rest RARE shared ones; FIXED sparse vectors are told apart.
SHARE, RARE, FIXED = 1 << 18, 1 << 13, 1 << 16
#: The bound of the sample of labelled documents that the network is fitted on.
MAX_TRAIN = 8000
THRESHOLD = 0.3

_SPACE, _WORD, _MARK = 0, 1, 2
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = _WORD


class WordVectors(NamedTuple):
    """words: hashes of those with vectors of their own, ascending. rows: theirs in that order, then the RARE shared ones."""

    words: np.ndarray
    rows: np.ndarray


def index_vectors() -> np.ndarray:
    """The fixed vectors: NONZERO entries of each row are +1 or -1, by a seeded rule. A word's row is told by the upper bits of its hash."""
    rng = np.random.default_rng(20240229)
    out = np.zeros((FIXED, DIM), np.int8)
    at = np.argsort(rng.random((FIXED, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), (FIXED, NONZERO)), axis=1)
    return out


def places(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The row of word vectors of each hash: its own, or one of those that rare words share."""
    shared = len(words) + (h % B.U(RARE)).astype(np.int64)
    if not len(words):
        return shared
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, shared)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, offsets of each text's tokens) of a block of texts."""
    kind = _KIND[data]
    n = len(data)
    if not n:
        return np.empty(0, B.U), np.zeros(len(at), np.int64)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    full = kind[start] != _SPACE
    start, end = start[full], end[full]
    return B.stretch(B.sums(data), start, end), np.searchsorted(start, at, "left")


def _stretches(data: np.ndarray, at: np.ndarray):
    """(hash of each token, offsets of each text's tokens, tokens at the beginning that came before) of a block of texts, or of the stretches of one long text."""
    if len(at) > 2 or len(data) <= B.BLOCK:
        yield *tokens(data, at), 0
        return
    before = np.empty(0, B.U)
    for part in B.parts(data):
        h = np.concatenate([before, tokens(part, np.array([0, len(part)]))[0]])
        yield h, np.array([0, len(h)]), len(before)
        before = h[-WINDOW:]


def _neighbours(h: np.ndarray, at: np.ndarray, fixed: np.ndarray, known: int = 0) -> np.ndarray:
    """Sum of the fixed vectors of the tokens within WINDOW of each token in its text; pairs of the first known tokens were summed before."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows = fixed[(h >> B.U(48)).astype(np.int64)]
    out = np.zeros_like(rows)  # 2 WINDOW at most
    for back in range(1, WINDOW + 1):
        same = doc[back:] == doc[:-back]
        same[: max(0, known - back)] = False
        out[back:] += rows[:-back] * same[:, None]
        out[:-back] += rows[back:] * same[:, None]
    return out


def frequent_words(docs: DataFrame, work: Workspace, text: str = "text", share: int = SHARE) -> np.ndarray:
    """Hashes, ascending, of the words that are one in share of all words of docs or more: share of them at most. Counts are summed by block, by task and by Spark."""

    def run(batches):
        for batch in batches:
            for _, _, data, at in B.blocks(batch.column(0)):
                for h, _, known in _stretches(data, at):
                    word, n = np.unique(h[known:], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    counts = work.save(docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.filter(F.col("n") >= -(-total // share)).select("word").toArrow()  # share rows at most
    work.drop("words")
    return np.sort(often.column("word").to_numpy().view(B.U))


def word_vectors(docs: DataFrame, text: str = "text", share: int = SHARE) -> WordVectors:
    """Word vectors of unit length from the neighbours of all words of docs; those that no word has are zeros."""
    words = frequent_words(docs, Workspace(docs.sparkSession, "quality"), text, share)
    size = len(words) + RARE
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        fixed, words = index_vectors(), shared.value
        total = np.zeros((size, DIM), np.int64)
        for batch in batches:
            for h, of, known in (x for _, _, data, at in B.blocks(batch.column(0)) for x in _stretches(data, at)):
                if len(h):
                    near = _neighbours(h, of, fixed, known)
                    at = places(h, words)
                    order = np.argsort(at, kind="stable")
                    there, first = np.unique(at[order], return_index=True)
                    total[there] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
        full = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(total[full, k]) for k in range(DIM)]], ["place", *[f"d{k}" for k in range(DIM)]])

    part = docs.select(text).mapInArrow(run, "place int, " + ", ".join(f"d{k} long" for k in range(DIM)))
    table = part.groupBy("place").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIM)]).toArrow()  # SHARE + RARE rows at most
    out = np.zeros((size, DIM), np.float32)
    if len(table):
        sums = np.stack([table.column(f"d{k}").to_numpy().astype(np.float64) for k in range(DIM)], axis=1)
        out[table.column("place").to_numpy()] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return WordVectors(words, out)


def pooled(texts: pa.Array, vectors: WordVectors) -> np.ndarray:
    """(rows, 2 DIM): mean and mean square of the word vectors of each whole text; zeros for one without words."""
    out, n = np.zeros((len(texts), 2 * DIM)), np.zeros((len(texts), 1), np.int64)
    for lo, hi, data, at in B.blocks(texts):
        for h, of, known in _stretches(data, at):
            of = np.maximum(of - known, 0)
            rows = vectors.rows[places(h[known:], vectors.words)]
            n[lo:hi, 0] += np.diff(of)
            out[lo:hi, :DIM] += B.tail(rows, of)
            out[lo:hi, DIM:] += B.tail(rows * rows, of)
    return (out / np.maximum(n, 1)).astype(np.float32)


class Network:
    """Two layers with tanh between, and one temperature for the logit; fitted by Adam with a fixed seed."""

    def __init__(self, width: int = 24, epochs: int = 120, batch: int = 256, rate: float = 0.01, decay: float = 1e-4):
        self.width, self.epochs, self.batch, self.rate, self.decay = width, epochs, batch, rate, decay
        self.temperature, self.base = 1.0, 0.5
        self.w: list[np.ndarray] | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), np.log(self.base / (1 - self.base)))
        a, b, c, d = self.w
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Network":
        """The last fifth, in seeded order, is held back for the temperature. With one label only, its smoothed share is the answer."""
        self.base = float((y.sum() + 1) / (len(y) + 2))
        if len(y) < 10 or y.min() == y.max():
            return self
        rng = np.random.default_rng(7)
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        held, order = order[:cut], order[cut:]
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.width)), np.zeros(self.width), rng.normal(0, self.width**-0.5, self.width), np.zeros(1)]
        first, second, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        for _ in range(self.epochs):
            order = rng.permutation(order)
            for lo in range(0, len(order), self.batch):
                at = order[lo : lo + self.batch]
                hidden = np.tanh(z[at] @ w[0] + w[1])
                wrong = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3][0], -30, 30))) - y[at]) / len(at)
                back = np.outer(wrong, w[2]) * (1 - hidden**2)
                slopes = [z[at].T @ back + self.decay * w[0], back.sum(axis=0), hidden.T @ wrong + self.decay * w[2], np.array([wrong.sum()])]
                t += 1
                for v, g, m, s in zip(w, slopes, first, second):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w = w
        logit, truth = self.logit(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        self.temperature = float(min(grid, key=lambda g: np.mean(np.logaddexp(0, logit / g) - truth * logit / g)))
        return self


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of five. A null id is not held out, and not learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: Broadcast, max_train: int = MAX_TRAIN) -> Network:
    """Fits on about max_train labelled documents, chosen by a hash of their id; vectors is a broadcast pair of WordVectors. Several labels of one document count as their mean, rounded up from a half."""
    known = labels.select(F.col("doc_id").alias("id"), "quality").filter(F.col("id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    share = max_train / max(max_train, known.count())
    some = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "id"), 11) < int(share * (1 << 53)))

    def run(batches):
        for batch in batches:
            x = pooled(batch.column(2), WordVectors(*vectors.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["id", "y", "x"])

    # the sample holds about max_train ids whatever the size of the tables, so it is broadcast and the texts aren't shuffled; of several rows of an id one is learned from
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(some), "id").select("id", "y", "text").mapInArrow(run, f"id {kind}, y int, x array<float>")
    rows = one.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(y), 2 * DIM)
    order = np.lexsort(x.T[::-1])  # the same network whatever order the tasks end in
    return Network().fit(x[order], y[order])


def score(docs: DataFrame, vectors: Broadcast, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each whole text. A null text is an empty one, whose score is that of a zero vector."""
    kind = docs.schema[key].dataType

    def run(batches):
        for batch in batches:
            p = network.probability(pooled(batch.column(2), WordVectors(*vectors.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], ["id", "held_out", "score"])

    out = docs.select(F.col(key).alias("id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, held_out boolean, score double")
    return out.select(F.col("id").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all docs by a network that labels teach. Null and empty texts are scored; repeated rows alike; with no usable labels
    every score is a half. Empty docs give no rows. Columns other than doc_id, text and quality aren't read."""
    docs = docs.select("doc_id", "text")
    vectors = docs.sparkSession.sparkContext.broadcast(tuple(word_vectors(docs)))
    return score(docs, vectors, fit(docs, labels, vectors))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
