"""Brute-force versions of the operators, on plain Python values."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, width):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    size = min(width, len(found))
    return frozenset(tuple(found[k : k + size]) for k in range(len(found) - size + 1))


def near_components(docs, width, percent):
    """{doc_id: (set size, smallest reachable id)} of (doc_id, text) with distinct ids."""
    sets = {i: shingle_set(text, width) for i, text in docs}
    holders = defaultdict(list)
    for i, held in sets.items():
        for shingle in held:
            holders[shingle].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, held in sets.items():
        shared = defaultdict(int)
        for shingle in held:
            for j in holders[shingle]:
                if j < i:
                    shared[j] += 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(held) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(held), find(i)) for i, held in sets.items()}
