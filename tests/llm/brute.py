"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str | None) -> set[tuple]:
    found = words(low(text or ""))
    if 0 < len(found) < 5:
        return {tuple(found)}
    return {tuple(found[k : k + 5]) for k in range(len(found) - 4)}


def components(rows: list[tuple[int, str | None]]) -> dict:
    """Position of a row -> smallest id that it is linked with."""
    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        ids[root(k)].append(doc_id)
    return {
        k: min((x for x in ids[root(k)] if x is not None), default=None) if sets[k] else rows[k][0]
        for k in range(len(rows))
    }


def without_repeats(rows: list[tuple[int, str | None]], window: int = 20) -> dict:
    """(doc_id, text) -> (n_words, n_removed, SHA-256 of the words that stay)."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, {}
    for doc_id, text in distinct:
        found = words(text)
        for k in range(len(found) - window + 1):
            first.setdefault(tuple(found[k : k + window]), (doc_id, k))
    for doc_id, text in distinct:
        found = words(text)
        gone = set()
        for k in range(len(found) - window + 1):
            if first[tuple(found[k : k + window])] != (doc_id, k):
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(found) if k not in gone)
        out[doc_id, text] = (len(found), len(gone), sha(kept))
    return out


def equal_texts(rows: list[tuple[int, str | None]]) -> dict:
    """Normalised text -> (id that stays, number of rows)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return {
        text: (min((x for x in ids if x is not None), default=None), len(ids))
        for text, ids in groups.items()
    }


def minimax(sizes: list[int], shards: int) -> int:
    """The smallest capacity of a contiguous partition."""

    def fits(capacity: int) -> bool:
        used, room = 1, capacity
        for size in sizes:
            if size > capacity:
                return False
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used <= shards

    low_, high = 0, sum(sizes)
    while low_ < high:
        middle = (low_ + high) // 2
        low_, high = (low_, middle) if fits(middle) else (middle + 1, high)
    return high


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """Share by weight; cap; share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    wanted, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = wanted - sum(capped.values())
        total = sum(weight[s] for s in free)
        now = {s: rest * weight[s] / total for s in free} if total else {}
        over = [s for s in free if now[s] > cap * sizes[s]]
        if not over:
            return {**capped, **now}
        capped |= {s: cap * sizes[s] for s in over}


def counts(values) -> Counter:
    return Counter(values)
