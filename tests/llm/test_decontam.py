import random

from pyspark.sql import functions as F

from plumbline.llm import decontam as D

BENCH = [
    (0, "John has 3 apples and buys 14 more at the market. How many apples does John have in total now?"),
    (1, "A train leaves the northern station travelling steadily towards the coast at a speed of 60 km per hour for 5 hours."),
    (2, "too short by far"),
    (3, None),
    (4, "seven silver spoons were carefully hidden beneath the old wooden floor by a very nervous butler"),
]


def leaks(spark, docs, bench=BENCH):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "h": F.lit("x")})
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(0))
    return {(r.doc_id, r.item_id): (r.kind, r.containment) for r in D.find_leaks(df, b).collect()}


def test_copies_and_new_parameters(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["blue", "stone", "river", "falls", "quiet"]) + str(rng.choice("abcxyz")) for _ in range(n))
    docs = [
        (1, f"{noise(40)}. {BENCH[0][1]} {noise(9)}"),
        (2, BENCH[0][1].replace("John", "Mary").replace("3", "8").replace("14", "25")),
        (3, BENCH[0][1].replace("does John", "does Peter")),  # 15 tokens word for word before it
        (4, f"{noise(30)} {BENCH[1][1].replace('60', '75').replace('5 hours', '9 hours')}"),
        (5, noise(3000)),
        (6, BENCH[4][1] + "\n" + BENCH[4][1]),
        (7, "seven silver spoons were carefully hidden beneath the old wooden floor by a rather nervous butler"),
        (8, "seven silver spoons were carefully"),
        (9, None),
        (10, ""),
        (11, "we saw seven silver spoons were carefully hidden beneath the old wooden floor by a friend"),
        (6, BENCH[4][1] + "\n" + BENCH[4][1]),
        (None, BENCH[4][1]),
    ]
    got = leaks(spark, docs)
    assert got[(1, 0)] == ("exact", 1.0) and got[(2, 0)][0] == "reparameterised" and got[(4, 1)][0] == "reparameterised" and got[(6, 4)] == ("exact", 1.0) and got[(None, 4)][0] == "exact"
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 1), (6, 4), (None, 4), (11, 4)} | {(7, 4)}


def test_planted_passages_are_all_found(spark):
    d = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in D.op9(spark, d).collect()}
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert got == {(x.doc_id, b.item_id) for b in bench for x in docs if b.text in x.text}


def test_windows_by_plain_words():
    import numpy as np
    import pyarrow as pa

    from plumbline.llm import _bytes as B

    texts = ["the cat sat on the mat. It cost 1,250.75 euros", "a b c d", "", "John met Ann Lee Bob at 5 km"]
    for _, _, data, at in B.blocks(pa.array(texts)):
        token, slot, of = D.canonical(data, at)
        row, place, h, slots = D.windows(data, at)
    assert np.diff(of).tolist() == [10, 4, 0, 8]
    assert [bool(s) for s in slot[:10]] == [False] * 8 + [True, True]
    assert row.tolist().count(1) == 0 and all((s == 0).sum() >= D.LITERALS for s in slots) and row.tolist().count(0) == 6


def test_empty_sides(spark):
    assert leaks(spark, []) == {} and leaks(spark, [(1, BENCH[0][1])], []) == {}


def test_clean_documents_stay(spark):
    rows = [("x", 1, BENCH[0][1]), ("y", 2, "clean text that nobody would mistake for a question of any kind"), ("z", None, None), ("z", 3, "")]
    df = spark.createDataFrame(rows, "tx string, doc_id long, text string")
    out = D.drop_leaking(df, spark.createDataFrame(BENCH, "item_id long, text string"))
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(rows[1:], key=repr)
