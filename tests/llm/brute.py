"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.decode("utf-8") for w in WORD.findall((text or "").encode())]


def fold(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, k):
    w = words(fold(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near_duplicates(rows, k, percent=80):
    """rows: (id, text) -> {id: (n, component)}"""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(rows, length=100):
    """rows: (id, text) -> sorted [(id, n_bytes, n_removed, n_spans, sha256 of the rest)], a place being (id, start)"""
    bodies = [(i, (text or "").encode()) for i, text in rows]
    first = {}
    for i, body in bodies:
        for p in range(len(body) - length + 1):
            w = body[p : p + length]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, body in bodies:
        covered = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if first[body[p : p + length]] < (i, p):
                covered[p : p + length] = b"\1" * length
        rest = bytes(x for x, c in zip(body, covered) if not c)
        spans = sum(1 for p in range(len(body)) if covered[p] and (p == 0 or not covered[p - 1]))
        out.append((i, len(body), sum(covered), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def base_statistics(text):
    w = words(text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, chars, symbols = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return (n, chars, symbols, dup, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def edit_distance_within(item, text):
    """Least edit distance of the item's words to any part of the text's."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def plain_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", fold(text))
