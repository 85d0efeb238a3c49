"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text: str | None) -> frozenset:
    words = WHITE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    first: dict[frozenset, int] = {}
    for k, s in enumerate(sets):
        if s:
            parent[find(k)] = find(first.setdefault(s, k))
    postings = defaultdict(list)
    for s, k in first.items():
        for x in s:
            postings[x].append(k)
    for s, k in first.items():
        shared = Counter(j for x in s for j in postings[x] if j > k)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least: dict[int, int] = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            root = find(k)
            least[root] = min(least.get(root, doc), doc)
    return [(doc, len(sets[k]), least.get(find(k)) if sets[k] else doc) for k, (doc, _) in enumerate(rows)]


def passages(rows: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept text)."""
    words = [WHITE_WORD.findall(t or "") for _, t in rows]
    first: dict[tuple, int] = {}
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is None:
            continue
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        if doc is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < doc:
                    gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def contamination(rows: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, items)."""
    windows = defaultdict(set)
    for item, text in items:
        w = PLAIN_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in rows:
        w = PLAIN_WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i : i + n]))
                if owners:
                    hit[i : i + n] = [True] * n
                    found |= {o for o in owners if o is not None}
        out.append((doc, len(w), sum(hit), sorted(found)))
    return out
