"""Plain single-machine versions of the corpus operators, for comparison."""

from __future__ import annotations

import hashlib
import re


def shingle_set(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.parent[max(a, b)] = min(a, b)


def near_duplicates(rows: list[tuple]) -> list[tuple]:
    """(id, n_shingles, component, kept) for (id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    union = Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    union.join(i, j)
    least: dict[int, int | None] = {}
    for i, (key, _) in enumerate(rows):
        root = union.find(i)
        known = least.get(root)
        least[root] = key if known is None else known if key is None else min(known, key)
    return [(key, len(sets[i]), c := least[union.find(i)], key == c) for i, (key, _) in enumerate(rows)]


def one_of_each_group(rows: list[tuple]) -> list[tuple]:
    """The (id, text) rows that stay where one of each group of near-duplicates does: the smallest id, nulls last."""
    sets = [shingle_set(t) for _, t in rows]
    union = Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    union.join(i, j)
    groups: dict[int, list] = {}
    for i, row in enumerate(rows):
        groups.setdefault(union.find(i), []).append(row)
    # among rows of one id any text may stay; the tests' groups leave no choice
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def kept_lines(rows: list[tuple], min_docs: int = 3, min_chars: int = 20) -> list[tuple]:
    """(id, n_lines, n_dropped, text) for (id, text) rows."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held: dict[str, set] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < min_docs or doc == max(held[key(x)])]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text: str | None) -> list[tuple]:
    """(start, kind, end) by start, then kind."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e in sorted(out)]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def license_places(text: str | None) -> list[tuple]:
    own = words(text)
    return sorted((i, label) for p, label in PHRASES.items() for i in range(len(own)) if own[i:i + len(p.split())] == p.split())


def schedule(units: dict[str, int], slots: int) -> list[str]:
    """Earliest deadline first, slot by slot."""
    total, done, out = sum(units.values()), dict.fromkeys(units, 0), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * total // units[s]), s) for s in sorted(units) if done[s] * total // units[s] <= t]
        best = min(ready)[1]
        done[best] += 1
        out.append(best)
    return out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
