"""Brute-force versions that several tests share."""

import re

import xxhash


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def dup_lines(docs):
    lines = sorted((d, i, s.strip(" \t\r\f\x0b")) for d, t in docs for i, s in enumerate(t.split("\n")))
    lines = [x for x in lines if x[2]]
    return {(d, i) for k, (d, i, s) in enumerate(lines) if any(s == t or near(s, t) for _, _, t in lines[:k])}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(docs):
    """The least id that can be reached from each."""
    fp, root = {i: fingerprint(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}
