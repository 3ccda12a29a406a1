"""Plain versions of the operators, one document or pair at a time, to hold results against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def thue_morse(n, a="a", b="b"):
    """Two words of 2**n letters that agree in every polynomial hash modulo 2**64, for n from 11 on at the latest."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def substring_dedup(docs, window=35):
    words = [(i, words_of(t)) for i, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def decontaminate(docs, items, window=10):
    patterns = defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            patterns[tuple(w[k : k + size])].add("" if i is None else str(i))
    sizes = sorted({len(p) for p in patterns})
    out = []
    for i, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (p := tuple(w[k : k + size])) in patterns:
                    hit.update(range(k, k + size))
                    found |= patterns[p]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def simhash(text, size=3):
    w = words_of((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs, distance=3):
    prints = [(i, simhash(t)) for i, t in docs]
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if (prints[x][1] ^ prints[y][1]).bit_count() <= distance:
                top[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(prints):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, f"{p:016x}", least.get(find(x))) for x, (i, p) in enumerate(prints)), key=str)


SECRETS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def secrets(text):
    found = []
    for rank, (kind, pattern) in enumerate(SECRETS.items()):
        for m in pattern.finditer(text or ""):
            size = len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]
            if size:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def quality(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            hit.update((k, k + 1, k + 2))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed
