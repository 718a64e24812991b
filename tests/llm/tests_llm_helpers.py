"""Brute-force versions of pipeline decisions."""

from __future__ import annotations


def groups(texts: dict) -> set:
    """The least id of each component of documents that share 80 % of their five-word shingles."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(lower).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


def contaminated(texts: dict, items: list, words_of, size: int = 10) -> set:
    wanted: dict = {}
    for _, t in items:
        w = words_of(t)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wanted.setdefault(k, set()).add(tuple(w[i : i + k]))
    out = set()
    for i, t in texts.items():
        w = words_of(t)
        if any(tuple(w[a : a + k]) in have for k, have in wanted.items() for a in range(len(w) - k + 1)):
            out.add(i)
    return out
