import hashlib
import random
import re

import pytest

from scorelake.llm import fingerprints as fp


def units(text):
    return {p for p in re.split(r"\n+|(?<=[.!?;:,])[ \t\n\x0b\f\r]+", text) if p.strip(" ")}


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, e, x = units(text), units(edited), units(after)
        like = lambda p, q: 1.0 if not p | q else len(p & q) / len(p | q)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, e), 9), round(like(a, x), 9)))
    return sorted(out, key=str)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma é", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(rng.randrange(2, 9))) + rng.choice([". ", "! ", ".\n", "; "])
    rows = [(i * 7, "".join(sentence() for _ in range(rng.choice([1, 3, 10, 40, 200])))) for i in range(n)]
    rows += [(3, None), (4, ""), (5, "x"), (6, "ab"), (8, rows[0][1]), (9, rows[0][1]), (10, "\n\n  \n"), (11, "one. " * 3000), (None, "the null document. It is last.")]
    rng.shuffle(rows)
    return rows


def rounded(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()), key=str)


@pytest.mark.parametrize("steps", [fp.STEPS, 0])
def test_rows(spark, steps):
    rows = corpus(120 if steps else 25)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, info string, n int").repartition(5)
    got = fp.fingerprints(docs, steps=steps).cache()
    assert rounded(got) == brute(rows)
    by_text = {}
    texts = dict(rows)
    for r in got.collect():
        assert by_text.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) >= len(by_text) - 2  # blank texts are alike
    if not steps:
        assert got.filter("attempts > 1").count() > 15  # all that differ
    got.unpersist()


def test_few(spark):
    one = spark.createDataFrame([(1, "abcdef. ghi")], "doc_id long, text string")
    assert rounded(fp.fingerprints(one)) == brute([(1, "abcdef. ghi")])
    assert fp.fingerprints(one.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (None, "a")], "doc_id long, text string")
    assert rounded(fp.fingerprints(nulls)) == brute([(None, "a")] * 3)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGES", 7)
    monkeypatch.setattr(fp, "RANGE_ROWS", 5)
    rows = [(i, f"text {i}. more") for i in range(200)] + [(10**12 + i, "far. away") for i in range(30)] + [(-5, "negative")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rounded(fp.fingerprints(docs)) == brute(rows)


def test_small_tables_are_tried_again(spark, monkeypatch):
    monkeypatch.setattr(fp, "LOAD", 0.6)
    rows = corpus(40, 9)
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rounded(got) == brute(rows) and got.filter("attempts > 1").count() > 5
