"""Plain reference versions for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    bodies = [(t or "").encode() for t in texts]
    seen: Counter = Counter()
    for b in bodies:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def sharing(texts: list[str | None], n: int) -> set[int]:
    """The places of the texts that have n words in a row that another one has, too."""
    holders = defaultdict(set)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(words) - n + 1):
            holders[tuple(words[i : i + n])].add(k)
    return set().union(*(ks for ks in holders.values() if len(ks) > 1))


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_groups(rows: list[tuple[int, str | None]], percent: int = 85) -> list[tuple[int, int, int, bool]]:
    """(doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    shared: Counter = Counter()
    for ks in holders.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (ident, _) in enumerate(rows):
        least[find(k)] = min(ident, least.get(find(k), ident))
    return [(ident, len(sets[k]), least[find(k)], least[find(k)] == ident) for k, (ident, _) in enumerate(rows)]
