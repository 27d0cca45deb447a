import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash as S
from plumbline.llm._store import Workspace
from plumbline.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a B c", "a b c d", "É é\x0bx y z Ä", "x " * 50000] + [" ".join(rng.choice("aBcdÉ") for _ in range(rng.randint(4, 60))) for _ in range(50)]
    for t in texts:
        assert S.fingerprint((t or "").encode()) == slow_fingerprint(t)


def test_code_words_near_every_word():
    g = S.Golay()
    assert g.width == 6
    codes = np.array([m << 11 | int(g.high[m]) for m in range(1 << 12)])
    assert np.bitwise_count(codes[1:]).min() == 7
    words = np.random.default_rng(1).integers(0, 1 << 23, 300)
    for w, near in zip(words, g.near(words)):
        assert {int(c) >> 11 for c in codes[np.bitwise_count(codes ^ w) <= 4]} == {int(x) for x in near if x >= 0}


def test_four_bits_leave_a_key():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        lo, hi = [(0, 64), (0, 22), (22, 43), (43, 64)][i % 4]
        for bit in rng.choice(np.arange(lo, hi), rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, ia = S.keys(a.view(np.int64))
    kb, ib = S.keys(b.view(np.int64))
    sa, sb = [set() for _ in a], [set() for _ in a]
    for s, k, i in ((sa, ka, ia), (sb, kb, ib)):
        for x, y in zip(k.tolist(), i.tolist()):
            s[y].add(x)
    assert all(x & y for x, y in zip(sa, sb)) and len(ka) / len(a) < 100


def test_runs_are_spanned():
    rng = np.random.default_rng(5)
    fp = np.concatenate([np.uint64(7) << np.uint64(40) ^ (np.uint64(1) << rng.integers(0, 30, 200, dtype=np.uint64)), rng.integers(0, 1 << 62, 50, dtype=np.uint64)])
    fp = np.unique(fp)
    edges = S.forest(fp)
    assert all(bin(a ^ b).count("1") <= 4 for a, b in edges) and len(edges) < len(fp)
    assert reach(edges, fp) == reach([(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :] if bin(int(a) ^ int(b)).count("1") <= 4], fp)


def reach(edges, nodes):
    root = {int(n): int(n) for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    return {n: find(n) for n in root}


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 200, 400]))]
        for _ in range(rng.choice([1, 2, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return [(i * 3 % 401, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (902, " \t"), (5000, docs[0]), (5000, docs[0])]


def expected(rows):
    fp = {t: slow_fingerprint(t) for _, t in rows}
    nodes = sorted(set(fp.values()))
    root = reach([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if bin(a ^ b).count("1") <= 4], nodes)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]] = min(least.get(root[fp[t]], i), i)
    return sorted([(i, f"{fp[t]:016x}", least.get(root[fp[t]])) for i, t in rows], key=repr)


def test_components_against_brute_force(spark):
    rows = corpus() + [(None, "alone by itself here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(5)
    got = sorted([tuple(r) for r in S.near_duplicates(df, Workspace(spark, "t")).collect()], key=repr)
    assert got == expected(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus() + [(7000, "one text of its own here"), (7000, "and quite another one with that id"), (None, "nobody knows my number")]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, fp int")
    out = S.drop_near_duplicates(df, Workspace(spark, "t"))
    assert out.columns == ["text", "doc_id", "fp"]
    groups = {c for _, _, c in expected(corpus())}
    assert sorted([-1 if r.doc_id is None else r.doc_id for r in out.collect()]) == sorted([*groups, 7000, 7000, -1])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df, Workspace(spark, "t")).count() == 0 and S.drop_near_duplicates(df, Workspace(spark, "t")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 600 + i) for i in range(50)] + [(3, 3), (9, -4), (9, 8), (-4, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == reach([e for e in edges if e[0] != e[1]], nodes)
