import random

from pyspark.sql import functions as F

from plumbline.llm import linededup as L
from plumbline.llm._store import Workspace


def near(a, b):
    """Within one edit, by trying all."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """(doc, place) of the lines that go."""
    lines = [(d, i, s.strip(" \t\r\f\x0b")) for d, t in docs if t is not None for i, s in enumerate(t.split("\n"))]
    lines = sorted({x for x in lines if x[2]}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    return {(d, i) for k, (d, i, s) in enumerate(lines) if any(s == t or near(s, t) for _, _, t in lines[:k])}


def fixture():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 20, 23, 24, 25, 26, 40, 41, 120]))).strip() + "x" for _ in range(60)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, op = rng.randrange(len(s)), rng.choice("rid")
                s = s[:k] + ("" if op == "d" else rng.choice("abcz")) + s[k + (op != "i") :]
            lines.append(rng.choice(["", " ", "\t"]) + s)
        docs.append((d, "\n".join([*lines, rng.choice(["", "Of.", "}"])])))
    long = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, long), (104, long[:3000] + "Q" + long[3000:]), (105, long[:3000] + "QQ" + long[3000:]), (106, docs[3][1]), (106, docs[3][1])]


def test_lines_against_brute_force(spark):
    docs = fixture()
    got = {(r.doc, r.ln) for r in L.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), Workspace(spark, "t")).collect()}
    assert got == brute(docs) and len(got) > 60


def test_documents_keep_the_rest(spark):
    docs = fixture()
    df = spark.createDataFrame([(t, d, "b", 7) for d, t in docs], "text string, doc_id long, words string, doc long")
    out = L.dedup_lines(df, Workspace(spark, "t"))
    assert out.columns == ["text", "doc_id", "words", "doc"]
    gone = brute(docs)
    want = []
    for d, t in docs:
        if t is not None:
            kept = [s for i, s in enumerate(t.split("\n")) if (d, i) not in gone]
            if len(kept) < len(t.split("\n")) and not "".join(kept).strip():
                continue
            t = "\n".join(kept)
        want.append((t, d, "b", 7))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_same_id_with_two_texts_and_null_id(spark):
    rows = [(1, "this is a line of words"), (1, "another line of words, so"), (2, "this is a line of words\nkeep me, I am alone"), (None, "another line of words, so")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.text) for r in L.dedup_lines(df, Workspace(spark, "t")).collect())
    assert out == [(-1, "another line of words, so"), (1, "this is a line of words"), (2, "keep me, I am alone")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(df, Workspace(spark, "t")).count() == 0 and L.duplicate_lines(df, Workspace(spark, "t")).count() == 0


def test_bits(spark):
    rows = [(1, 5, ln) for ln in (0, 63, 64, 200)]
    b = L._bits(spark.createDataFrame(rows, "doc long, tx long, ln int")).first()
    hit = spark.range(210).select("id", L._dropped(F.array(*[F.lit(w).cast("long") for w in b.words]), F.col("id").cast("int")).alias("d")).filter("d").collect()
    assert [r.id for r in hit] == [0, 63, 64, 200] and b.n_removed == 4


def test_lines_of_one_first_hash_are_told_apart(spark, monkeypatch):
    """Even if the first hash of all lines were equal, the second keeps them apart; and it is no function of the first."""
    from plumbline.llm import linededup

    docs = spark.createDataFrame([(1, "one line here\nanother line there\none line here"), (2, "a third line\nanother line there")], "doc_id long, text string")
    want = sorted(map(tuple, linededup.duplicate_lines(docs, Workspace(spark, "t")).select("doc", "ln").collect()))
    assert want == [(1, 2), (2, 1)]
    a, b = docs.select(*linededup.identity(F.col("text"))).first()
    assert b != spark.range(1).select(F.xxhash64(F.lit(7))).first()[0] and b != spark.createDataFrame([(a,)], "h long").select(F.xxhash64("h", F.lit(7))).first()[0]
    monkeypatch.setattr(linededup, "identity", lambda line: [F.lit(0).cast("long"), F.xxhash64(F.lit(7), line)])
    assert sorted(map(tuple, linededup.duplicate_lines(docs, Workspace(spark, "t")).select("doc", "ln").collect())) == want
