"""METEOR's alignment against a search through all alignments."""

import random
import time

import pytest

from scorelake.functions.alignment import EXACT, aligned, classes, meteor
from scorelake.operators import captions


def brute(a, b):
    """(matches, fewest chunks) over all alignments."""
    best = (0, 0)

    def go(i, used, pairs):
        nonlocal best
        if i == len(a):
            chunks = sum(k == 0 or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1) for k in range(len(pairs)))
            best = max(best, (len(pairs), -chunks))
            return
        go(i + 1, used, pairs)
        for j, w in enumerate(b):
            if w == a[i] and j not in used:
                go(i + 1, used | {j}, [*pairs, (i, j)])

    go(0, frozenset(), [])
    return best[0], -best[1]


def test_all_alignments():
    rng = random.Random(5)
    for _ in range(700):
        letters = "ab" if rng.random() < 0.2 else "abcd" if rng.random() < 0.5 else "abcdefgh"
        n, m = (rng.randint(0, 6) if letters == "ab" else rng.randint(0, EXACT) for _ in range(2))
        a, b = [rng.choice(letters) for _ in range(n)], [rng.choice(letters) for _ in range(m)]
        assert aligned(a, b) == brute(a, b), (a, b)


def test_long_sides():
    rng = random.Random(6)
    for n in (9, 10):  # beyond EXACT: the most matches, and nearly always the fewest chunks
        worse = 0
        for _ in range(60):
            a, b = ([rng.choice("abcdefg") for _ in range(n)] for _ in range(2))
            got, want = aligned(a, b), brute(a, b)
            assert got[0] == want[0] and got[1] >= want[1]
            worse += got[1] > want[1]
        assert worse <= 3
    distinct = [str(i) for i in range(3000)]
    assert aligned(distinct, distinct) == (3000, 1) and aligned(distinct[1500:] + distinct[:1500], distinct) == (3000, 2)
    text = [rng.choice("the a of and dog cat man park runs sees".split()) for _ in range(3000)]
    start = time.time()
    assert aligned(text, text) == (3000, 1)
    assert aligned(text, text[::-1])[0] == 3000 and time.time() - start < 60


def test_meteor():
    assert meteor("the cat sat".split(), "the cat sat".split()) == pytest.approx(1 - 0.5 / 27)
    assert meteor([], ["a"]) == meteor(["a"], []) == meteor(["a"], ["b"]) == 0
    assert meteor("a dog is running".split(), "a dog runs".split()) > meteor("a dog is sleeping".split(), "a dog runs".split())
    groups = {"fast": "g1", "quick": "g1", "slow": "g2"}
    assert meteor(["quick"], ["fast"], groups) == 0.5 and meteor(["slow"], ["fast"], groups) == 0
    assert classes(["runs"], ["running"], {"run": "x"}) == ([("group", "x")], [("group", "x")])  # a stem's group is that of all its words
    # the first `the` goes with the chunk, not with the first place
    assert aligned("the dog".split(), "the cat the dog".split()) == (2, 1)


def test_scores(spark):
    rows = [("1", "a quick dog", "a fast dog"), ("2", "a quick dog", "a quick dog"), ("3", "", "a"), ("4", None, "a"), ("5", "x", "y")]
    frame = spark.createDataFrame(rows, "pair string, prediction string, reference string")
    synonyms = spark.createDataFrame([("Quick", "g1"), ("fast", "g1"), ("fast", "g2"), (None, "g1"), ("dog", None)], "word string, group string")
    plain = {r.pair: r.meteor for r in captions.alignment_scores(frame, "pair").collect()}
    held = {r.pair: r.meteor for r in captions.alignment_scores(frame, "pair", synonyms=synonyms).collect()}
    assert set(plain) == set(held) == {"1", "2", "3", "5"}
    assert plain["1"] < held["1"] == held["2"] == plain["2"] == pytest.approx(1 - 0.5 / 27, abs=1e-6) and held["3"] == held["5"] == 0
