import hashlib

from pyspark.sql import functions as F

from plumbline.llm import warc
from plumbline.llm._store import Workspace

SCHEMA = "page_id long, url string, html string"


def run(spark, rows, shards=3):
    work = Workspace(spark, "test-warc")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit("x"), "key": F.lit(1)})
    index = warc.Index(warc.write_archives(df, work), work, shards)
    return df, work, index


def test_round_trip_and_revisits(spark):
    big, odd = "<p>é</p>" * 300, "y" * 1000
    rows = [(i, f"http://WWW.Example{i % 7}.com:80/a?b={i}#c", big if i % 3 == 0 else f"page {i}") for i in range(90)]
    rows += [(200, None, None), (201, "", ""), (202, "not a url\n\t", odd), (203, "http://x.org/", odd), (204, "http://x.org", "y" * 999), (205, "http://x.org", "y" * 999), (None, "http://n.org/", odd)]
    rows += [(203, "http://x.org/", odd)]  # a row that repeats
    df, work, index = run(spark, rows)
    keys = df.select(warc.url_key(F.col("url")).alias("key"), "page_id")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload) if r.payload is not None else None) for r in warc.read_records(index.lookup(keys), work.root, 3, payload=True).collect()]
    best = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            best[raw] = max(best.get(raw, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = raw in best and best[raw] != i
        want.append((i, "revisit" if again else "response", best[raw] if again else None, len(raw), hashlib.sha1(raw).hexdigest(), None if again else raw))
    order = lambda xs: sorted(xs, key=repr)
    assert order(got) == order(want)


def test_lookup_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, "http://same.org/", f"{i}") for i in range(50)] + [(100 + i, f"http://h{i:02}.org/", "z") for i in range(30)]
    df, work, index = run(spark, rows, 4)
    want = spark.createDataFrame([("org,same)/", 17), ("org,same)/", 49), ("org,h05)/", 105), ("org,nowhere)/", 1), ("", None), ("org,same)/", 17)], "key string, page_id long")
    assert sorted((r.key, r.page_id) for r in index.lookup(want).collect()) == [("org,h05)/", 105), ("org,same)/", 17), ("org,same)/", 49)]


def test_keys(spark):
    urls = ["http://user@www.Example.com:80/Path?q=1#x", "https://a.b.c", None, "odd one", "http://h/ s"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/Path?q=1", "c,b,a)/", "", "~odd_one", "h)/_s"]


def test_empty_table(spark):
    df, work, index = run(spark, [])
    assert index.top == [] and warc.read_records(index.lookup(df.select(F.lit("a").alias("key"), "page_id")), work.root, 2).count() == 0
