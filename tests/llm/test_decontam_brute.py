"""Leaks against a plain reading of the rules, every diagonal of every document and item."""

import random
import re
from collections import Counter

from plumbline.llm import decontam as D

WORDS = re.compile(r"(?:[A-Za-z0-9]|(?<=\d)[.,](?=\d))+")


def tokens(text):
    """(kind, word) of each token."""
    out = []
    for w in WORDS.findall(text or ""):
        low, capital = w.lower(), w[0].isupper()
        kind = D.LITERAL
        if capital and any(c.islower() for c in w) and low not in D.STARTERS:
            kind = D.NAME
        if low in D.UNITS and not capital:
            kind = D.UNIT
        if w[0].isdigit() or low in D.NUMBERS:
            kind = D.NUMBER
        out.append((kind, low))
    return out


def merged(ts):
    out = []
    for k, w in ts:
        if out and k in (D.NUMBER, D.NAME) and out[-1][0] == k:
            out[-1] = (k, out[-1][1] + (w,))
        else:
            out.append((k, (w,)))
    return out


def windows(text, form):
    ts = tokens(text)
    if form == D.MERGED:
        ts = merged(ts)
    width = D.WINDOW
    if form >= D.PLAIN:
        ts = [(D.LITERAL, w) for _, w in ts]
        width = form - D.PLAIN or D.WINDOW
        if width == 1 and len(ts) != 1:
            return {}
    out = {}
    for i in range(len(ts) - width + 1):
        w = ts[i : i + width]
        if form >= D.PLAIN or sum(k == D.LITERAL for k, _ in w) >= D.LITERALS:
            out[i] = (tuple((k, x) if k == D.LITERAL else k for k, x in w), [x for k, x in w if k != D.LITERAL])
    return out


def forms(text):
    if windows(text, D.ALL) or windows(text, D.MERGED):
        return [D.ALL, D.MERGED]
    n = len(tokens(text))
    return [] if not n else [D.PLAIN if n >= D.WINDOW else D.PLAIN + n]


def best_chain(met, width):
    """All pairs of windows are looked at: those that can precede a window, and the best of them."""
    met = sorted(met)
    best = []
    for k, (a, b) in enumerate(met):
        ways = [((width, 0, 1), [k])]
        for j in range(k):
            if met[j][0] < a and met[j][1] < b:
                (cover, changes, n), path = best[j]
                ways.append(((cover + min(width, a - met[j][0]), changes - (b - a != met[j][1] - met[j][0]), n + 1), [*path, k]))
        best.append(max(ways, key=lambda w: w[0]))
    return [met[k] for k in max(best, key=lambda w: w[0])[1]] if best else []


def leaks(doc, item):
    for form in forms(item):
        mine, theirs = windows(item, form), windows(doc, form)
        width = (form - D.PLAIN or D.WINDOW) if form >= D.PLAIN else D.WINDOW
        tokens = {t for a in mine for t in range(a, a + width)}
        equal_places = [(a, b) for a in mine for b in theirs if mine[a][0] == theirs[b][0]]
        for diagonal in {b - a for a, b in equal_places}:
            line = best_chain([(a, b) for a, b in equal_places if abs(b - a - diagonal) <= D.SHIFT], width)
            met = {(a, b): list(zip(mine[a][1], theirs[b][1])) for a, b in line}
            seen = Counter(p for w in met.values() for p in w)
            most = {}
            for (own, other), n in seen.items():
                most[own] = max(most.get(own, (0, False, ())), (n, own == other, other))
            for good in ([x for x in line if all(a == b for a, b in met[x])], [x for x in line if all(most[a][2] == b for a, b in met[x])]):
                whole = {t for a, _ in good for t in range(a, a + width)}
                gaps, gap = [], 0
                for t in range(min(tokens), max(tokens) + 2):
                    if t in whole or t > max(tokens):
                        gaps.append(gap)
                        gap = 0
                    else:
                        gap += 1
                half = sum(g // 2 for g in gaps[1:-1] if g <= D.GAP) + sum(g // 2 for g in (gaps[0], gaps[-1]) if g < D.WINDOW and len(gaps) > 1)
                spots = set(good)
                row = max((next(n for n in range(1, 99) if (a + n, b + n) not in spots) for a, b in good), default=0)
                if good and (round(min(1.0, (len(whole) + half) / len(tokens)), 6) >= D.CONTAINED and 2 * len(whole) >= len(tokens) or row >= D.RUN):
                    return True
    return False


def corpus():
    rng = random.Random(12)
    lower, names, units = "river stone quiet market buys sells walks counts after before old wooden bridge the of and to".split(), ["John", "Mary", "Ann", "Lee", "Peter"], ["km", "miles", "hours"]
    word = lambda: rng.choice([*lower * 2, *names * 2, *units, "7", "12", "1,250.5", "three"])
    items = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 25, 40]))) for _ in range(50)]
    items += ["Alice Bob 12 45 Carol 9 77 Dave Erin 5", "", None, items[3]]
    docs = []
    for _ in range(160):
        item = rng.choice(items) or "x"
        parts = item.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            parts[rng.randrange(len(parts))] = word()
        if rng.random() < 0.4:  # other values throughout
            other = {w: rng.choice([*names, "9", "31", "Jo Beth"]) for w in {*names, "7", "12"}}
            parts = [other.get(w, w) for w in parts]
        docs.append(" ".join([*(word() for _ in range(rng.choice([0, 0, 3, 30]))), *parts, *(word() for _ in range(rng.choice([0, 0, 5])))]))
    return docs + [None, "", "..."], items


def test_every_diagonal(spark):
    docs, items = corpus()
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if leaks(doc, item)}
    assert got == want and len(want) > 60


def test_short_and_literal_poor_items(spark):
    items = ["Paris lies in France", "Alice Bob 12 45 Carol 9 77 Dave Erin 5", "yes", "two words"]
    docs = ["we said that Paris lies in France.", "x " + items[1] + " y", "Carol Bob 12 45 Alice 9 77 Dave Erin 5", "yes", "yes or no", "Yes!", "Paris, lies in Spain", "two words of it"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in D.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), b).collect()}
    assert got == {(0, 0, "exact"), (1, 1, "exact"), (3, 2, "exact"), (5, 2, "exact"), (7, 3, "exact")}


def edited(words, n, kind, rng):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(1, len(words) - 1)
        if kind == "in":
            words.insert(k, rng.choice(("really", "then", "also")))
        elif kind == "out":
            del words[k]
        else:
            words[k] = rng.choice(("really", "then", "also"))
    return words


def test_edited_items_are_found(spark):
    """Every item of the benchmark with one to three words put in, taken out or changed, between other text: what is found is counted, whatever the rules say."""
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rows, what = [], {}
    for i, text in items:
        for kind in ("in", "out", "other"):
            for n in (1, 2, 3):
                what[len(rows)] = (i, kind, n)
                noise = lambda: " ".join(rng.choice(("zebra", "quilt", "onyx", "fjord", "gnome")) + str(rng.choice("abcdef")) for _ in range(12))
                rows.append((len(rows), f"{noise()}. {' '.join(edited(text.split(), n, kind, rng))} {noise()}"))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    long = {i for i, text in items if len(text.split()) >= 25}
    share = lambda kind, n, of: sum((d, i) in got for d, (i, k, m) in what.items() if (k, m) == (kind, n) and i in of) / len(of)
    recall = {(kind, n): (share(kind, n, {i for i, _ in items}), share(kind, n, long)) for kind in ("in", "out", "other") for n in (1, 2, 3)}
    print({k: tuple(round(x, 3) for x in v) for k, v in recall.items()})
    assert all(whole >= 0.9 for (_, n), (whole, _) in recall.items() if n < 3) and all(some >= 0.9 for _, some in recall.values()), recall
    assert {i for d, i in got if what[d][0] != i} == set()


def test_scattered_stretches_are_no_leak(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = [word() for _ in range(120)]
    doc = [w if k % 13 < 5 else word() for k, w in enumerate(item)]
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = [(1, " ".join(doc)), (2, " ".join([word() for _ in range(9)] + item[30:43])), (3, " ".join([word() for _ in range(9)] + item[30:42])), (4, "\u00c1ngel " + " ".join(item[:20]))]
    got = {r.doc_id for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert got == {2, 4}


def test_accented_capitals_are_names(spark):
    items = [(1, "\u00c9lodie buys several ripe pears and \u00c9lodie sells them again at noon every single day")]
    docs = [(1, "Ant\u00f3n buys several ripe pears and Ant\u00f3n sells them again at noon every single day"), (2, "\u00c1ngel buys several ripe pears and \u00c1ngel sells them")]
    got = {(r.doc_id, r.kind) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, "reparameterised")}
