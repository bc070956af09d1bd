"""METEOR's alignment of two lists of words: most matches, then fewest chunks (runs that follow each other on both sides).

Words match if they are of one class: equal, of equal stems, or of one group of a table of synonyms. Matching is within classes, so the most matches are known beforehand (of each class, as many as the side that has fewer),
and the search is only for the fewest chunks.
"""

from __future__ import annotations

from scorelake.functions.porter import stem

#: Words of the shorter side up to which all alignments are searched; states kept beyond; places tried for a word beyond, where more than twice as many are free, besides the one that goes on with a chunk.
EXACT, BEAM, PLACES = 8, 32, 4


def classes(a: list[str], b: list[str], groups: dict[str, str] | None = None) -> tuple[list, list]:
    """Each word's class: its stem, or the group that a word of this stem has (the first by name, if several have)."""
    of: dict[str, str] = {}
    for word, group in (groups or {}).items():
        s = stem(word)
        of[s] = min(of.get(s, group), group)
    made: dict[str, object] = {}
    for word in {*a, *b}:
        s = stem(word)
        made[word] = ("group", of[s]) if s in of else s
    return [made[w] for w in a], [made[w] for w in b]


def _first(mask: int, most: int):
    """The first so many places of a mask."""
    for _ in range(most):
        if not mask:
            return
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def aligned(a: list, b: list) -> tuple[int, int]:
    """(matches, chunks) of two lists of classes: the most matches, and the fewest chunks that have as many. Exact where the shorter side has EXACT words at most;
    else the best of BEAM partial alignments at each word, of which none gives up a match."""
    if len(b) > len(a):
        a, b = b, a
    places: dict[object, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    left: dict[object, int] = {}
    for c in a:
        if c in places:
            left[c] = left.get(c, 0) + 1
    matches = sum(min(n, places[c].bit_count()) for c, n in left.items())
    exact = len(b) <= EXACT
    # a state: places of b that are taken, and the place of the word before (-2 for none); and its chunks
    states: dict[tuple[int, int], int] = {(0, -2): 0}
    for i, c in enumerate(a):
        if c not in places:
            states = _fewest(((used, -2), n) for (used, _), n in states.items())
            continue
        left[c] -= 1
        follow = places.get(a[i + 1], 0) >> 1 if i + 1 < len(a) else 0
        states = _fewest(_next(states, places[c], left[c], follow, exact))
        if not exact and len(states) > BEAM:
            rank = lambda item: (item[1] - (follow >> item[0][1] & 1 if item[0][1] >= 0 else 0), item[1], item[0][1])  # noqa: E731, B023
            states = dict(sorted(states.items(), key=rank)[:BEAM])
    return matches, min(states.values())


def _fewest(found) -> dict[tuple[int, int], int]:
    best: dict[tuple[int, int], int] = {}
    for state, n in found:
        if n < best.get(state, n + 1):
            best[state] = n
    return best


def _next(states: dict[tuple[int, int], int], mine: int, later: int, follow: int, exact: bool):
    """States after a word whose class has the places mine and comes so many times later; follow has the places that the next word's could follow."""
    for (used, last), n in states.items():
        free = mine & ~used
        if free.bit_count() <= later:  # the word may stay alone without giving up a match
            yield (used, -2), n
        on = last + 1
        if last >= 0 and free >> on & 1:
            yield (used | 1 << on, on), n
            free ^= 1 << on
        if exact or free.bit_count() <= 2 * PLACES:
            tried = _first(free, free.bit_count())
        else:
            after = (free >> on << on) if last >= 0 else 0
            tried = {*_first(free & follow, PLACES), *_first(after & follow, 1), *_first(after, 1), *_first(free, 1)}
        for j in tried:
            yield (used | 1 << j, j), n + 1


def meteor(a: list[str], b: list[str], groups: dict[str, str] | None = None) -> float:
    """METEOR of a candidate's words against a reference's: the recall-weighted mean of precision and recall, less a penalty for chunks; 0 without a match."""
    if not a or not b:
        return 0.0
    matches, chunks = aligned(*classes(a, b, groups))
    if not matches:
        return 0.0
    p, r = matches / len(a), matches / len(b)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / matches) ** 3)
