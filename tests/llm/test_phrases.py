"""Repeated passages against a plain dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import phrases
from plumbline.llm._store import Workspace
from plumbline.llm.phrases import drop_repeats, removed_repeats, runs, windows

SHAPE = "doc_id long, text string, n_words long, first string"


def plain(docs):
    split = [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in split:
        for k in range(len(w) - 12):
            p = tuple(w[k : k + 13])
            least[p] = min(i, least.get(p, i))
    out = []
    for (given, _), (i, w) in zip(docs, split):
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((given, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 3)))
    passages = [[word() for _ in range(r.choice((12, 13, 14, 40, 70)))] for _ in range(6)] + [["la"] * 60, ["x", "y"] * 30]
    docs = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            w += [word() for _ in range(r.randint(0, 20))] + (p if r.random() < 0.6 else p[a : a + r.randint(5, 40)])
        docs.append((i, r.choice((" ", "\n", "\t ", "  ")).join(w)))
    docs += [(r.choice([100, 7, None]), docs[k][1]) for k in (3, 4, 5, 5)] + [(200, None), (201, ""), (202, " \n"), (None, docs[9][1] + " tail"), (None, docs[9][1]), (7, docs[7][1]), (7, docs[7][1])]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_windows_by_hand(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SHAPE).repartition(3)
    got = removed_repeats(df, Workspace(spark, "t")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in plain(docs)], key=key)


def test_special_grams_and_small_automata_change_nothing(spark, monkeypatch):
    """Every gram is wide or hot: phrases are dealt out by hash, documents by salt."""
    for name, n in (("PHRASES", 8), ("OCCURRENCES", 2)):
        monkeypatch.setattr(phrases, name, n)
    docs = corpus(3)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SHAPE).repartition(2)
    work = Workspace(spark, "t")
    distinct = phrases.texts(df, work, "doc_id", "text")
    stretch = phrases.stretches(distinct, work)
    shards = phrases.Shards(phrases.phrases(stretch, work), 3)
    assert any(p > 1 for _, p, _ in shards.special.values()) and any(c > 1 for _, _, c in shards.special.values())
    got = removed_repeats(df, Workspace(spark, "t")).select("doc_id", "n_words", "n_removed").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([x[:3] for x in plain(docs)], key=key)


def test_texts_are_cut_and_other_columns_stay(spark):
    docs = corpus(4)
    df = spark.createDataFrame([(i, t, 5, "kept") for i, t in docs], SHAPE)
    got = drop_repeats(df, Workspace(spark, "t"))
    assert got.columns == df.columns
    want = [(i, t if g == 0 else k, 5, "kept") for (i, t), (_, _, g, k) in zip(docs, plain(docs))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_no_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    assert removed_repeats(none, Workspace(spark, "t")).collect() == [] and drop_repeats(none, Workspace(spark, "t")).collect() == []


def test_windows_depend_on_their_own_words_alone():
    w = [str(k % 17).encode() for k in range(40)]
    of = lambda words, sizes: windows(words, np.array(sizes), 8)
    row, first, gram, own = of(w, [40])
    assert len(gram) == 28 and all((of(w[k : k + 13], [13])[2][0], of(w[k : k + 13], [13])[3][0]) == (gram[k], own[k]) for k in range(28))
    assert len(of(w[:12], [12])[0]) == len(of(w[:20], [9, 0, 11])[0]) == 0
    row, first, g, o = of(w, [14, 3, 0, 23])
    assert row.tolist() == [0, 0] + [3] * 11 and first.tolist() == [0, 1, *range(17, 28)] and (g == gram[first]).all() and (o == own[first]).all()
    assert runs(np.array([1, 2, 3, 5, 6]), np.array([0, 0, 1, 1, 1])) == [(0, 1), (2, 2), (3, 4)]


def test_blocks_are_whole_rows(monkeypatch):
    monkeypatch.setattr(phrases, "WORDS", 5)
    got = [(lo, words, sizes.tolist()) for lo, words, sizes in phrases.blocks(pa.array([b"a b", b"", b"c d e", b"f", b"g h i j k l", b"m"]))]
    assert got == [(0, [b"a", b"b", b"c", b"d", b"e"], [2, 0, 3]), (3, [b"f"], [1]), (4, b"g h i j k l".split(), [6]), (5, [b"m"], [1])]
