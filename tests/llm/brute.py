"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def near_components(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, int]:
    """The smallest id reachable from each id; all pairs of different sets are compared."""
    parent = {i: i for i, _ in docs}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    by_set: dict[frozenset, int] = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        s = shingles(text, n)
        if s:
            parent[root(i)] = root(by_set.setdefault(s, i))
    sets = list(by_set.items())
    for k, (s, i) in enumerate(sets):
        for t, j in sets[:k]:
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                common = len(s & t)
                if 100 * common >= percent * (len(s) + len(t) - common):
                    parent[root(i)] = root(j)
    groups: dict[int, list[int]] = {}
    for i in parent:
        groups.setdefault(root(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def quality_base(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def personal(text: str | None) -> list[tuple[str, int, int]]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd, even = digits[-1::-2], digits[-2::-2]
            luhn = sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn % 10 == 0 or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def tokens(text: str | None) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def overlaps(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int, percent: int, least: int) -> set[tuple[int, int]]:
    """(doc, item) with enough equal tokens in some window on some diagonal; every diagonal is tried."""
    out = set()
    for i, text in docs:
        d = tokens(text)
        for j, item in items:
            t = tokens(item)
            if len(t) < least:
                continue
            w = min(window, len(t))
            for shift in range(-len(t), len(d)):
                same = [0 <= k + shift < len(d) and d[k + shift] == t[k] for k in range(len(t))]
                if any(100 * sum(same[k:k + w]) >= percent * w for k in range(len(t) - w + 1)):
                    out.add((i, j))
                    break
    return out
