"""Plain versions of what the text operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EMPTY_HASH = sha256(b"").hexdigest()


def words(text: str | None) -> list[str]:
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(w: list[str], n: int, whole: bool) -> frozenset:
    if whole and 0 < len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def alike(a: frozenset, b: frozenset, p: int = 4, q: int = 5) -> bool:
    n = len(a & b)
    return n > 0 and n * q >= p * (len(a) + len(b) - n)


def classes(rows) -> dict[int, tuple[int, int]]:
    """For each id its least reachable id and its number of links."""
    sets = {i: windows(words(t), 5, True) for i, t in rows}
    ids, root, links = sorted(sets), {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and alike(sets[a], sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def repeated_lines(rows) -> set[tuple[int, int]]:
    lines = [(i, n, windows(words(x), 5, True)) for i, t in sorted(rows) if t is not None for n, x in enumerate(t.split("\n"))]
    by_window, out = defaultdict(list), set()
    for k, (i, n, own) in enumerate(lines):
        near = {j for w in own for j in by_window[w]}
        if any(alike(own, lines[j][2]) for j in near):
            out.add((i, n))
        for w in own:
            by_window[w].append(k)
    return out


def contamination(docs, items, size: int = 10) -> dict:
    """n_words, n_hit, items and contaminated of each document."""
    known = defaultdict(set)
    for name, text in items:
        w = words(text)
        for x in windows(w, min(size, len(w)), False) if w else ():
            known[x].add(str(name))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in known}:
            for k in range(len(w) - n + 1):
                if x := known.get(tuple(w[k : k + n])):
                    found |= x
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def joined(kinds, spans, by_start: bool) -> str:
    rows = [(a, k, b) if by_start else (k, a, b) for k, own in enumerate(spans) for a, b in own]
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in (r if by_start else (r[1], r[0], r[2]) for r in sorted(rows)))
