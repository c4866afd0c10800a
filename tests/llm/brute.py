"""Plain versions of the text operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(rows, window=50):
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        if i is not None:
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality(text):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cover = Counter(runs), set()
    for i, r in enumerate(runs):
        if n[r] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


def quality_kept(text):
    """The verdict of all quality rules, spelled out."""
    w, lines = words(text), (text or "").split("\n")
    n, chars, symbols, dup, repeat = quality(text)

    def most(k):
        return max(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)).values(), default=0)

    if n < 20 or 100 * repeat > 30 * n or 100 * symbols > 25 * n or 2 * dup > len(lines) or not 2 * n <= chars <= 15 * n:
        return False
    if 100 * sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w) < 70 * n:
        return False
    if n >= 200 and 100 * len(set(w)) < 2 * n:
        return False
    return n < 50 or 100 * most(2) <= 10 * n and 100 * most(3) <= 6 * n and 100 * most(4) <= 4 * n


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k=5, percent=80):
    """doc_id -> (n_shingles, component_id); ids are unique."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y:
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}
