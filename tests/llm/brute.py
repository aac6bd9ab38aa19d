"""Plain versions of the operators, one text at a time, to hold the real ones against."""

from __future__ import annotations

import re

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, rule: re.Pattern) -> list[str]:
    return rule.findall((text or "").translate(LOWER))


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = words(text, SPACE)
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])


def components(sets: list[frozenset], ids: list) -> list[tuple[int, object]]:
    """(size, smallest id reachable) of each set, by comparing all pairs."""
    head = list(range(len(sets)))

    def find(i: int) -> int:
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                head[max(find(i), find(j))] = min(find(i), find(j))
    lowest: dict[int, object] = {}
    for i, v in enumerate(ids):
        if v is not None:
            lowest[find(i)] = min(lowest.get(find(i), v), v)
    return [(len(s), lowest.get(find(i)) if s else ids[i]) for i, s in enumerate(sets)]


def contamination(text: str | None, items: list[tuple[str, str]], window: int = 13) -> tuple[int, int, list[str]]:
    """(words, hit words, items) of one document."""
    w = words(text, ALNUM)
    hit, found = set(), set()
    for item, content in items:
        v = words(content, ALNUM)
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)
