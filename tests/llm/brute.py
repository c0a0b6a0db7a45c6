"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def repeats(rows):
    """[(doc_id, text)] -> sorted list of result rows of the 200-byte contract."""
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - 199):
            seen[b[s : s + 200]] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near(rows):
    """[(doc_id, text)] -> (doc_id, n_shingles, component_id, kept)."""
    sets = [shingle_set(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in at[x] if j < k)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                root[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None and (r not in low or i < low[r]):
            low[r] = i
    out = []
    for k, (i, _) in enumerate(rows):
        c = low.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(text):
    """Base counts and digest of one text."""
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    spans, counts = [], []
    for kind, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        found = [(m.start(), m.end()) for m in p.finditer(t) if ok[kind](m.group(0))]
        counts.append(len(found))
        spans += [f"{kind}:{a}:{b}" for a, b in found]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans))


def edit_distance_in(pattern, text):
    """Least edit distance of a word list to any run of another."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, w in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != w)))
        row = new
    return min(row)


def plain_words(text):
    return re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", (text or "").encode().lower())


def leaks(docs, items):
    out = []
    for d, t in docs:
        w = plain_words(t)
        for i, x in items:
            p = plain_words(x)
            if p:
                e = edit_distance_in(p, w)
                if e <= len(p) // 4:
                    out.append((d, i, len(p), e))
    return sorted(out, key=str)
