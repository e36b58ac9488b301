"""Symmetric-delete neighbourhoods and weighted edit distances.

Two strings within k edits share a string reachable from each by at most k
deletions, so an index of deletions turns a similarity join into an equi-join.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from ..functions.folding import fold  # noqa: F401  used beside these

#: Letters next to each other on a keyboard; hitting one for the other is cheap.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


@lru_cache(maxsize=1)
def _neighbours() -> frozenset[tuple[str, str]]:
    found = set()
    for y, row in enumerate(_ROWS):
        for x, a in enumerate(row):
            near = [row[x + 1 : x + 2]] + ([_ROWS[y + 1][max(0, x - 1) : x + 1]] if y + 1 < len(_ROWS) else [])
            for b in "".join(near):
                found |= {(a, b), (b, a)}
    return frozenset(found)


def deletes(word: str, most: int) -> set[str]:
    """``word`` and everything left of it after up to ``most`` deletions."""
    found = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        for gone in combinations(range(len(word)), k):
            kept, last = [], 0
            for i in gone:
                kept.append(word[last:i])
                last = i + 1
            kept.append(word[last:])
            found.add("".join(kept))
    return found


def edit_cost(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein distance (optimal string alignment).

    A swap of neighbours or a doubled letter costs 0.7, a key next to the right
    one 0.8, any other edit 1; an edit of the first letter 0.3 more.
    """
    near = _neighbours()
    before: list[float] = []
    row = [float(j) + (0.3 if j else 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        first = 0.3 if i == 1 else 0.0
        now = [i + 0.3]
        for j, y in enumerate(b, 1):
            if x == y:
                best = row[j - 1]
            else:
                best = row[j - 1] + (0.8 if (x, y) in near else 1.0) + (first if j == 1 else 0)
                gone = 0.7 if i > 1 and a[i - 2] == x else 1.0
                come = 0.7 if j > 1 and b[j - 2] == y else 1.0
                best = min(best, row[j] + gone, now[j - 1] + come)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before[j - 2] + 0.7)
            now.append(best)
        before, row = row, now
    return row[-1]


def edits(a: str, b: str) -> int:
    """Plain Damerau-Levenshtein distance (optimal string alignment)."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + (x != y), row[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return row[-1]


def shortens(short: str, full: str, least: int = 2) -> bool:
    """Is ``short`` a cut or squeezed form of the one word ``full``?

    A cut form is a beginning of it; a squeezed one keeps the first letter and
    a subsequence of the rest, and has no more vowels than a third of its letters.
    """
    if len(short) < least or len(short) >= len(full) or short[0] != full[0]:
        return False
    if full.startswith(short):
        return True
    if not squeezed(short):
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def squeezed(short: str) -> bool:
    """Has a word so few vowels that others may have been left out of it?"""
    return sum(c in "aeiouyåäöæø" for c in short) * 3 <= len(short)
