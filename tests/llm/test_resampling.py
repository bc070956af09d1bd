import hashlib
import math
import random
import re
import zlib

import pytest

from scorelake.llm import resampling

SCHEMA = "doc_id long, text string"


def features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, size=10_000, longest=1, least=20, percent=10, seed=2024):
    bucket = lambda w: zlib.crc32(w.encode()) % size
    raw, aim = [0] * size, [0] * size
    for texts, counts in ((docs, raw), (target, aim)):
        for row in texts:
            for w in features(row[1], longest)[1]:
                counts[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + size) / ((s + 1) * (sum(aim) + size)))) for s, t in zip(raw, aim, strict=True)] if docs else []
    rows = []
    for i, (doc_id, text) in enumerate(docs):
        n_words, own = features(text, longest)
        weight = sum(gain[bucket(w)] for w in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None, n_words, i])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "ÀÉ", "straße", "42", "naïve", "中文", "z-z", "a_b", "Q", "\x85", "x y", "İ"]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 21, 40]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(out)] + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "w" * 50_000), (n + 4, "long words " * 20_000)]


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


TARGET = [(0, "the 42 naïve 中文"), (1, None), (2, ""), (3, "straße The")]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 35), (3, 100), (1, 0)])
def test_against_brute_force(spark, monkeypatch, longest, percent):
    monkeypatch.setattr(resampling, "LEAST", 7)  # several ranges
    docs = texts(400)
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], SCHEMA + ", score int, row string").repartition(6)
    made = resampling.resample(frame, spark.createDataFrame(TARGET, "item_id long, text string"), longest=longest, percent=percent)
    assert got(made) == brute(docs, TARGET, longest=longest, percent=percent)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_repeated_and_null_ids(spark):
    text = "the of the " * 10
    docs = [(None, text)] * 40 + [(7, text)] * 40 + [(i, text) for i in range(20)] + [(None, "of " * 20)] * 3
    assert got(resampling.resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(TARGET, "item_id long, text string"), percent=50)) == brute(docs, TARGET, percent=50)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], SCHEMA), texts(60)
    frame = spark.createDataFrame(docs, SCHEMA)
    assert resampling.resample(none, frame).count() == 0
    assert got(resampling.resample(frame, none, percent=30)) == brute(docs, [], percent=30)


def test_text_ids(spark):
    docs = texts(120)
    made = resampling.resample(spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string"), spark.createDataFrame(TARGET, "item_id long, text string"), percent=20).collect()
    ranked = sorted((r for r in made if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(ranked) + 1)) and ranked == sorted(ranked, key=lambda r: (-r.score, r.doc_id))


@pytest.mark.parametrize("longest", [1, 3])
def test_chunks(monkeypatch, longest):
    monkeypatch.setattr(resampling, "CHUNK", 10)
    monkeypatch.setattr(resampling, "CACHED", 5)
    buckets = resampling.Buckets(1000)
    for _, text in texts(50):
        parts = list(buckets.of((text or "").encode(), longest))
        n_words, own = features(text, longest)
        assert sum(n for n, _ in parts) == n_words and sorted(b for _, found in parts for b in found) == sorted(zlib.crc32(w.encode()) % 1000 for w in own)


def test_ranges():
    levels = {9: 2, 8: 3, 7: 1, 5: 10, 4: 100}
    assert resampling.ranges_of(levels, 6, 3) == ([8, 7], [0, 5])
    assert resampling.ranges_of(levels, 7, 1) == ([9, 8, 7, 5], [0, 2, 5, 6])
    assert resampling.ranges_of(levels, 0, 3) == ([], [])


def test_tournament():
    rng = random.Random(3)
    runs = [sorted((rng.randrange(50), i, j) for j in range(rng.randrange(1, 9))) for i in range(37)]
    tree, out = resampling.Tournament(), []
    for i, keys in enumerate(sorted(runs)):
        while tree.best < keys[0]:
            block, at = tree.pop()
            out.append(sorted(runs)[block][at])
        tree.enter(i, keys, i)
    while tree.best < resampling.END[0]:
        block, at = tree.pop()
        out.append(sorted(runs)[block][at])
    assert out == sorted(k for keys in runs for k in keys)
