import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import mixing as M
from plumbline.llm._store import Workspace


def slow_quotas(target, most, seats):
    out = [0] * len(target)
    for _ in range(seats):
        open_ = [(-t / (2 * k + 1), i) for i, (t, k, m) in enumerate(zip(target, out, most)) if t and k < m]
        if not open_:
            break
        out[min(open_)[1]] += 1
    return out


def slow_targets(sizes, weights, repeats=3):
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n], float(sum(sizes))
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if rate * weights[i] > repeats * sizes[i]]
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else rate * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def sources(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "number long, want double, most long")


def seats_of(spark, rows, unit=1):
    df = sources(spark, rows)
    return [r.q for r in df.withColumn("q", M.quota_of(df, F.col("want"), F.col("most"), unit)).orderBy("number").collect()]


def test_seats_go_to_the_highest_quotients(spark):
    rng = np.random.default_rng(4)
    cases = [[(1.5, 9)] * 7, [(2.5, 3), (2.5, 3), (1.0, 1)], [(0.2, 1)] * 11, [(100.5, 200), (0.5, 1), (0.5, 1)], [(0.0, 0), (3.0, 3)], [(0.49, 1)] * 40 + [(30.0, 30)]]
    for _ in range(6):
        n = int(rng.integers(1, 9))
        cases.append([(float(w), int(np.ceil(w)) + int(rng.integers(0, 3))) for w in rng.integers(0, 300, n) / 8])
    for rows in cases:
        want, most = [w for w, _ in rows], [m for _, m in rows]
        assert seats_of(spark, rows) == slow_quotas(want, most, int(sum(want) + 0.5)), rows


def test_targets_share_all(spark):
    rng = np.random.default_rng(5)
    for _ in range(6):
        n = int(rng.integers(1, 12))
        sizes, weights = [int(x) for x in 10 ** rng.uniform(0, 6, n) - 1], [1 + i % 3 for i in range(n)]
        df = spark.createDataFrame(list(zip(range(n), sizes, map(float, weights))), "number long, size long, weight double")
        got = [r.t for r in df.withColumn("t", M.target_of(M.rate_of(df))).orderBy("number").collect()]
        assert np.allclose(got, slow_targets(sizes, weights)) and abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))


def test_numbers_follow_the_order_over_many_partitions(spark):
    rows = [(f"s{i:05d}é", i) for i in range(3000)]
    df = spark.createDataFrame(rows[::-1], "source string, i int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert all(r.number == r.i for r in M.numbered(df, Workspace(spark, "t"), "n", "source").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shards_of_a_source_add_up():
    for blocks, quota in [(5000, 7321), (5000, 14999), (3, 1), (1024 * 3, 0), (2, 5)]:
        got = np.concatenate([M.uses(s, 3, blocks, quota) for s in range(-(-blocks // M.SHARD))])
        assert len(got) == blocks and got.sum() == quota and got.max() - got.min() <= 1


def mixed(spark, rows, **kw):
    return M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), Workspace(spark, "t"), **kw)


def rows_of(n=1200):
    rng = np.random.default_rng(1)
    return [(i, " ".join(["w"] * int(rng.integers(0, 90))), ["big", "big", "b", "c", "tiny", None][i % 6] if i % 40 or i % 6 != 4 else "tiny") for i in range(n)]


def test_sources_come_near_their_targets(spark):
    rows = [r for r in rows_of() if r[2] != "tiny" or r[0] % 60 == 4]
    out = mixed(spark, rows).toPandas()
    assert len(out) == len(rows)
    size = {i: len(t.split()) for i, t, _ in rows}
    assert all(size[i] == s for i, s in zip(out.doc_id, out["size"])) and (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    source = {i: s for i, _, s in rows}
    out["source"] = [source[i] or "~" for i in out.doc_id]
    per = out.groupby("source").agg(target=("target", "first"), n=("target", "nunique"), taken=("taken", "sum"), size=("size", "sum"), stated=("source_size", "first"))
    assert (per.n == 1).all() and (per["size"] == per.stated).all() and ((per.taken - per.target).abs() <= 16).all()
    want = slow_targets(per["size"].tolist(), [1, 2, 3, 1, 2][: len(per)])
    assert np.allclose(per.target, want) and per.target["tiny"] == 3 * per["size"]["tiny"]


def slow_taken(spark, rows):
    """(id, taken) by writing out every block of every source and using it word by word."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at = df.select("doc_id", "source", M.word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("tx")).withColumn("order", F.xxhash64(F.lit(M.SEED), "doc_id", "n")).collect()
    names = sorted({r.source for r in at}, key=lambda s: (s is None, (s or "").encode()))
    size = [sum(r.n for r in at if r.source == s) for s in names]
    want = slow_targets(size, [1 + i % 3 for i in range(len(names))])
    full = [3 * (n // 16) for n in size]
    first = [min(t, 16.0 * m) for t, m in zip(want, full)]
    quota = slow_quotas(first, full, int(sum(first) / 16 + 0.5))
    odd = [3 * (n % 16) for n in size]
    lack = [min(max(t - 16 * q, 0.0), float(m)) for t, q, m in zip(want, quota, odd)]
    rest = slow_quotas(lack, odd, int(sum(lack) + 0.5))
    got = []
    for i, s in enumerate(names):
        mine = sorted((r for r in at if r.source == s), key=lambda r: (r.order, r.doc_id, r.tx))
        word = []
        for unit, n, seats, who in ((16, size[i] // 16, quota[i], i), (1, size[i] % 16, rest[i], ~i & (1 << 62) - 1)):
            use = [u for k in range(-(-n // M.SHARD)) for u in M.uses(k, who, n, seats)]
            word += [int(u) for u in use for _ in range(unit)]
        for r in mine:
            got.append((r.doc_id, sum(word[: r.n])))
            word = word[r.n :]
    return sorted(got, key=repr)


def test_words_taken_of_each_document(spark):
    rows = [r for r in rows_of(500) if r[2] != "tiny"] + [(9001, "a b c", "tiny"), (9002, "a b c d e", "small"), (9003, " ".join("w" * 20), "twenty"), (9004, " ".join("w" * 100), "hundred"), (9005, "x", None)]
    out = mixed(spark, rows)
    got = sorted(((r.doc_id, r.taken) for r in out.collect()), key=repr)
    assert got == slow_taken(spark, rows)
    taken = dict(got)
    assert taken[9001] == 9 and taken[9002] == 15 and taken[9003] == 60 and taken[9004] == 300


def test_a_thousand_sources_of_a_few_words(spark):
    rows = [(i, " ".join("w" * (i % 7)), f"s{i % 1000}") for i in range(3000)]
    assert sorted(((r.doc_id, r.taken) for r in mixed(spark, rows).collect()), key=repr) == slow_taken(spark, rows)


def test_reruns_agree_however_rows_are_dealt(spark):
    rows = rows_of(400)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mixed(spark, rows)) == key(mixed(spark, rows[::-1])) != key(mixed(spark, rows, seed=5))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "x y", "b"), (4, "a b c\x0bd", "b"), (4, "a b c\x0bd", "b")]
    out = sorted([(r.doc_id or -1, r.size, r.source_size) for r in mixed(spark, rows).collect()])
    assert out == [(-1, 2, 8), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 3, 8), (4, 3, 8)]
    assert mixed(spark, [(1, None, "a")]).first().taken == 0
    assert mixed(spark, []).columns == ["doc_id", "size", "source_size", "target", "taken"] and mixed(spark, []).count() == 0
