import datetime as dt

from plumbline.llm import urlfilter as U

DAY = dt.date(2024, 1, 1)


def test_entries_of_many_parts(spark):
    deep = "example.com/" + "/".join(f"p{i}" for i in range(12))
    entries = [("l", "example.com", "allow"), ("l", "example.com/a/b", "allow"), ("l", "example.com/a/b/c", "block"), ("l", "example.com/a/b/c/d/e.html", "allow"), ("l", deep, "block"), ("l", None, "block")]
    urls = {
        "http://example.com/a/b/c": ("block", "example.com/a/b/c"),
        "http://example.com/a/b/c/d/": ("block", "example.com/a/b/c"),
        "https://Example.com:80//a/b/c/d/e.html?x=1#y": ("allow", "example.com/a/b/c/d/e.html"),
        "http://example.com/a/b/d": ("allow", "example.com/a/b"),
        "http://example.com/a/bb/c": ("allow", "example.com"),
        f"http://{deep}": ("block", deep),
        f"http://{deep}/x/y": ("block", deep),
        "http://example.com/p0": ("allow", "example.com"),
        "http://example.org/a/b/c": ("none", None),
    }
    c = spark.createDataFrame([(i, u, DAY) for i, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    e = spark.createDataFrame([(*x, DAY) for x in entries], "list string, key string, action string, listed_on date")
    assert {r.url: (r.verdict, r.matched_key) for r in U.evaluate(c, e).collect()} == urls
