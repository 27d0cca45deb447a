import datetime as dt
import random

from plumbline.llm import urlfilter as U

DAY = dt.date(2024, 1, 1)


def keys(url):
    import re

    m = re.match(r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::\d*)?([^?#]*)", url or "")
    if not m or not m[1]:
        return set()
    host, parts = m[1].lower(), [p for p in m[2].split("/") if p]
    labels = host.split(".")
    return {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {"/".join([host, *parts[:k]]) for k in range(1, len(parts) + 1)}


def verdict(url, day, entries):
    best = None
    for k in keys(url):
        for name in {e[0] for e in entries}:
            held = [e for e in entries if e[0] == name and e[1] == k and e[3] <= day]
            if held and day is not None:
                last = max(e[3] for e in held)
                action = max(e[2] for e in held if e[3] == last)
                if action != "off":
                    best = max(best or (0,), (len(k), action, name, k, last))
    return best[1:] if best else ("none", None, None, None)


def check(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date")
    e = spark.createDataFrame(entries, "list string, key string, action string, listed_on date")
    got = sorted([(r.page_id, r.url, r.fetched_on, r.verdict, r.list, r.matched_key, r.listed_on) for r in U.evaluate(c, e).collect()], key=repr)
    good = [x for x in entries if None not in x[1:]]
    want = []
    for p, u, d in captures:
        v = verdict(u, d, good) if d else ("none", None, None, None)
        want.append((p, u, d, v[0], v[1], v[2], v[3]))
    assert got == sorted(want, key=repr)


def test_against_every_entry(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "example.com", "b.example.com", "x.org", "deep.er.x.org"]
    day = lambda: DAY + dt.timedelta(rng.randint(0, 200))
    entries = [(rng.choice(["l1", "l2"]), rng.choice([*hosts, "org", "a.example.com/p", "a.example.com/p/q", "a.example.com/p/q/r", "x.org/p/q/r/s"]), rng.choice(["block", "allow", "off"]), day()) for _ in range(80)]
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/q', 'p/q/r', 'p/q/r/s/t', 'z'])}", day()) for i in range(150)]
    captures += [(900, None, DAY), (901, "no url", DAY), (902, "http://a.example.com", None), (903, "HTTP://u@A.Example.com:80/p?x", day()), captures[0], captures[0], (None, captures[1][1], captures[1][2])]
    entries += [("l1", None, "block", DAY), ("l1", "x.org", "block", None), ("l1", "x.org", None, DAY), entries[0]]
    check(spark, captures, entries)


def test_empty_sides(spark):
    check(spark, [], [("l", "x.org", "block", DAY)])
    check(spark, [(1, "http://x.org/", DAY)], [])


def test_interval_over_many_periods(spark):
    e = [("l", "x.org", "block", DAY), ("l", "x.org", "off", DAY + dt.timedelta(2000)), ("l", "x.org", "allow", DAY + dt.timedelta(2001))]
    check(spark, [(i, "http://x.org/", DAY + dt.timedelta(i)) for i in (0, 31, 32, 1999, 2000, 2001, 4000)], e)
