"""Plain forms of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

SPACE_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return SPACE_SPLIT.findall(text or "")


def shingles(text: str | None, width: int = 5) -> set:
    w = words(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def components(sets: dict[int, list[set]], percent: int = 80) -> dict[int, int]:
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(sets, 2):
        if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def without_repeats(rows: list[tuple[int, str | None]], width: int = 13) -> list[tuple[int, int, int, str]]:
    texts = [(i, words(t)) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in texts:
        for j in range(len(w) - width + 1):
            g = tuple(w[j : j + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


SECRETS = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m[g]) >= least)
