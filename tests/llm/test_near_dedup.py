import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import components as cc
from scorelake.llm import near_dedup as nd


def word_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def exact(text, n):
    w = word_list(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [(i, exact(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a & b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 15, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "x" * 9000 + " y z q"), (n + 7, "X" * 9000 + " Y z\x0bq"), (n + 8, "É y"), (n + 9, "é y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 4096), (5, 80, 5)])
def test_against_all_pairs(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, component string, doc int")
    got = nd.near_duplicates(docs, words, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, words, percent)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e"), (5, "p q r s t"), (7, "a b c d e"), (3, "p q r s t"), (None, "a b c d e"), (None, "alone in the world"), (None, None)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(5, 3, False), (5, 3, False), (7, 3, False), (3, 3, True), (None, 3, False), (None, 3, False), (None, None, True)], key=str)
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 3, 85).count() == 0
    # one id with three texts ties three groups; its texts are near copies of others
    near = lambda word: " ".join(f"{word}{i}" for i in range(60))
    rows = [(9, near("a")), (9, near("b")), (9, near("c")), (9, near("c")), (4, near("a") + " x"), (8, near("b") + " y"), (2, "z " + near("c")), (1, near("d"))]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (4, 2), (8, 2), (9, 2), (9, 2), (9, 2), (9, 2)]


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(120)] + [(9, 9)]
    got = {r.id: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert got == {x: find(x) for x in parent}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \té\n.x"), max_size=60))
def test_words(text):
    words = word_list(text)
    h = nd.word_hashes(text)
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert len(nd.shingles(text, 3)) == len(exact(text, 3))


def test_steps(monkeypatch):
    text = ("Some words of a longer text " * 50 + "y" * 5000 + " and Z ") * 3
    whole = nd.word_hashes(text)
    monkeypatch.setattr(nd, "STEP", 300)
    assert nd.word_hashes(text).tolist() == whole.tolist() and len(whole) == len(word_list(text))


def test_estimates():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    for share in (0.5, 0.7, 0.9):
        both = int(len(base) * share)
        a, b = base[: (len(base) + both) // 2], base[(len(base) - both) // 2 :]
        true = len(np.intersect1d(a, b)) / len(base)
        bits = [np.frombuffer(nd.sketch(np.sort(x))[1], np.uint64) for x in (a, b)]
        assert abs(nd.estimate(nd.equal_bits(*bits)) - true) < 0.16


def test_exact_links():
    rng = np.random.default_rng(3)
    root = np.unique(rng.integers(0, 1 << 62, 80))
    sets = []
    for _ in range(120):
        own = rng.permutation(root)[: rng.integers(60, 81)]
        sets.append(np.union1d(own, rng.integers(0, 1 << 62, rng.integers(0, 9))))
    table = pa.table({"doc": pa.array(range(120), pa.int64()), "component": pa.array(range(120), pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "delta": pa.array([np.setxor1d(x, root) for x in sets], pa.list_(pa.int64()))})
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(pairs):
        parent[:] = range(120)
        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(120)]

    true = [(a, b) for a in range(120) for b in range(a) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    links = nd.exact_links(table, table, 85)
    assert set(links) <= {x for a, b in true for x in ((a, b), (b, a))} and len(links) < 120
    assert join(true) == join(links) and len(set(join(true))) > 3


def test_extended(spark):
    rng = random.Random(11)
    first = [(rng.randrange(200), rng.randrange(200)) for _ in range(80)]
    more = [(rng.randrange(260), rng.randrange(260)) for _ in range(60)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    labels = cc.components(frame(first))
    got = {r.id: r.component for r in cc.extended(labels, frame(more)).collect()}
    whole = {r.id: r.component for r in cc.components(frame(first + more)).collect()}
    assert got == whole
    assert cc.extended(labels, frame([(5, 5)])).count() == labels.count()


def test_families_below_and_above_the_threshold(spark, monkeypatch):
    """Many texts that are close to the threshold, with roots that aren't linked with all of theirs: what the roots leave apart is found across them."""
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 300)
    rng = random.Random(5)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        for _ in range(45):
            text = list(base)
            for at in rng.sample(range(0, 118, 4), rng.choice([1, 2, 3, 5, 6])):
                text[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()
    want = brute(rows, 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert 3 < len({c for _, _, c, _ in want}) < 120
