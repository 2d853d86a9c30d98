"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def rows_of(texts, source="s"):
    """Rows of documents from texts; sources alternate over three names and null."""
    return [(i, t, "en", [source, "a", None, "b"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def base_counts(text):
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return (len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered))


def shingles(text):
    found = [w.translate(LOWER) for w in words(text)]
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def union(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_components(docs, percent=85):
    """doc_id -> component for (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return union(links, ids)


def repeated_bytes(docs, length=50):
    """doc_id -> (bytes, removed flags) for (doc_id, text)."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        out.append((i, b, gone))
    return out


def mix_targets(sizes, share=1.5, most=2):
    """Targets of (source, size) pairs in their order, by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), list(names)
    while free:
        given = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if given[s] > most * sizes[s]]
        if not over:
            out.update(given)
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
