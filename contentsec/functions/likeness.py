"""How much of two texts is in common, in order: difflib's number, found by plain searches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher


#: Rough microseconds: of a search, more for each character that it passes; of a character and a pair of places in difflib.
_SEARCH, _PASSED, _CHARACTER, _PAIR = 0.2, 0.0003, 0.15, 0.08


def _runs(a: str, b: str) -> tuple[list[int], list[int], float]:
    """Starts and stops of the runs of `a` in which difflib looks for matches: of characters that `b`, which has 200
    characters or more, holds in at most a hundredth of its places and one; and in
    how many places of it each of their characters is, on average."""
    most = len(b) // 100 + 1
    rare = {c: n for c, n in Counter(b).items() if n <= most}
    counts = Counter(a)
    other = counts.keys() - rare
    pairs = sum(n * rare[c] for c, n in counts.items() if c in rare) / max(1, sum(n for c, n in counts.items() if c in rare))
    if not other:
        return [0], [len(a)], pairs
    gap = min(other)
    starts, stops, at = [], [], 0
    for run in a.translate(dict.fromkeys(map(ord, other), gap)).split(gap):
        if run:
            starts.append(at)
            stops.append(at + len(run))
        at += len(run) + 1
    return starts, stops, pairs


def _ahead(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from i and j on are the same."""
    if a[i : i + most] == b[j : j + most]:
        return most
    same = 0
    while most - same > 1:
        half = (same + most) // 2
        same, most = (half, most) if a[i + same : i + half] == b[j + same : j + half] else (same, half)
    return same


def _behind(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters before i and j are the same."""
    if a[i - most : i] == b[j - most : j]:
        return most
    same = 0
    while most - same > 1:
        half = (same + most) // 2
        same, most = (half, most) if a[i - half : i - same] == b[j - half : j - same] else (same, half)
    return same


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(). Of the longest runs that both texts hold difflib takes the first, which it finds
    from all places of all characters; here runs are searched for by length, and where that has taken as long as difflib would,
    in texts that have little in common, and for short ones difflib does it."""
    if len(b) < 200 or not a:
        return SequenceMatcher(None, a, b).ratio()
    starts, stops, pairs = _runs(a, b)
    matcher = None

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        nonlocal matcher
        runs = [(max(start, alo), min(stop, ahi)) for start, stop in zip(*(x[bisect_right(stops, alo) : bisect_left(starts, ahi)] for x in (starts, stops)), strict=True)]
        left = sum(stop - start for start, stop in runs) * (_CHARACTER + _PAIR * pairs * (bhi - blo) / len(b))
        for size in range(min(max((stop - start for start, stop in runs), default=0), bhi - blo), 0, -1):
            for start, stop in runs:
                for i in range(start, stop - size + 1):
                    if (j := b.find(a[i : i + size], blo, bhi)) >= 0:
                        return grown(i, j, size, alo, ahi, blo, bhi)
                    if (left := left - _SEARCH - _PASSED * (size + bhi - blo)) < 0:
                        matcher = matcher or SequenceMatcher(None, a, b)
                        return tuple(matcher.find_longest_match(alo, ahi, blo, bhi))
        return grown(alo, blo, 0, alo, ahi, blo, bhi)

    def grown(i: int, j: int, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """The match with the same characters around it, frequent ones too."""
        before = _behind(a, i, b, j, min(i - alo, j - blo))
        return i - before, j - before, before + size + _ahead(a, i + size, b, j + size, min(ahi - i, bhi - j) - size)

    held, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        i, j, size = longest(alo, ahi, blo, bhi)
        if size:
            held += size
            if alo < i and blo < j:
                open_.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                open_.append((i + size, ahi, j + size, bhi))
    return 2.0 * held / (len(a) + len(b))
