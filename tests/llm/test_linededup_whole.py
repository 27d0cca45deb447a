import random

from plumbline.llm import linededup as L
from plumbline.llm._store import Workspace


def gone(spark, docs):
    return {(r.doc, r.ln) for r in L.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), Workspace(spark, "t")).collect()}


def test_near_copies_of_over_a_million_characters(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh é", k=1_100_000)).strip()
    k = 700_000
    docs = [(1, long), (2, long[:k] + "Q" + long[k:]), (3, long[:k] + "R" + long[k + 1 :]), (4, long[:k] + "QRS" + long[k:])]
    assert gone(spark, docs) == {(2, 0), (3, 0)}


def test_lines_of_any_length_up_to_two_pieces(spark):
    rng = random.Random(3)
    docs, want = [], set()
    for k, n in enumerate([*range(1, 25), L.PIECE - 1, L.PIECE, L.PIECE + 1, 2 * L.PIECE, 2_000_000]):
        mark = chr(0x4E00 + k)  # lines of other pairs are further than an edit away
        s = mark * 2 + "".join(rng.choices("abcdefgh é", k=n)).strip() + mark
        at = rng.randrange(2, len(s))
        docs += [(2 * k, s), (2 * k + 1, s[:at] + "Q" + s[at + (k % 2) :])]
        want.add((2 * k + 1, 0))
    assert gone(spark, docs) == want


def test_lines_of_a_few_characters(spark):
    assert gone(spark, [(1, "a\n\n \nab\nabc"), (2, "xyz\nx\n\nwxyz")]) == {(1, 3), (1, 4), (2, 1), (2, 3)}


def test_short_lines_within_one_edit(spark):
    assert gone(spark, [(1, "Subscribe to our blog."), (2, "Subscribe to our blog!"), (3, "Subscribe to our blogs!!"), (4, "abcdefg\nabcdefgh"), (5, "abcdefgx\nabcdefghi")]) == {(2, 0), (4, 1), (5, 0), (5, 1)}
    rng = random.Random(6)
    base = ["".join(rng.choices("abc ", k=rng.randint(8, 24))).strip() + "x" for _ in range(40)]
    docs = []
    for d in range(80):
        s = rng.choice(base)
        k, op = rng.randrange(len(s)), rng.choice("rid")
        docs.append((d, s[:k] + ("" if op == "d" else rng.choice("abcz")) + s[k + (op != "i") :]))
    want = set()
    lines = [(d, t.strip()) for d, t in docs]
    for k, (d, s) in enumerate(lines):
        for _, t in lines[:k]:
            a, b = sorted((s, t), key=len)
            if s == t or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1 or any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
                want.add((d, 0))
    assert gone(spark, docs) == want


def test_texts_of_lines_that_meet_none_are_not_shuffled(spark):
    """Two of 2,001 lines are near each other; where nothing is broadcast by its size, the texts of the others still stay where they are read."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=5_000)) for _ in range(2_000)]
    docs = [*enumerate(texts), (2_000, texts[7][:2_500] + "-" + texts[7][2_500:])]
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in map(sc.statusStore().executorList(True).apply, range(sc.statusStore().executorList(True).size())))

    before, most = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert gone(spark, docs) == {(2_000, 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert shuffled() - before < 5e6  # of 10 MB of texts


def test_lines_that_meet_none_are_not_fetched(spark):
    """Of the lines whose texts are read again, few are no suspects, whatever Spark makes of the join after that; all suspects are there, by null keys too."""
    lines = spark.range(200_000).selectExpr("if(id % 50 = 0, null, id) AS doc", "xxhash64(id) AS tx", "cast(id % 7 AS int) AS ln", "repeat('x', 9) AS line")
    suspects = lines.filter("tx % 20 = 0").drop("line")
    out = L._marked(lines, suspects)
    assert out.columns == lines.columns and out.join(suspects.dropDuplicates(), ["tx", "ln"]).count() == (n := suspects.count()) > 5_000
    assert out.count() < 1.1 * n
    assert L._marked(lines, suspects.limit(0)).count() == 0


def test_a_few_bits_lose_no_line(spark, monkeypatch):
    """With so few bits that all lines pass, and with a few more, the results are those of many."""
    rng = random.Random(4)
    docs = [(d, "\n".join("".join(rng.choices("ab", k=rng.randint(5, 9))) for _ in range(5))) for d in range(40)]
    want = gone(spark, docs)
    for bins, words in ((1, 1), (3, 2)):
        monkeypatch.setattr(L, "MARK_BINS", bins)
        monkeypatch.setattr(L, "MARK_WORDS", words)
        assert gone(spark, docs) == want
