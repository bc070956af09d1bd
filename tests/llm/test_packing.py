import zlib
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expand(rows):
    """Bins as lists of (offset, length), by sequence."""
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, last, per, base, at in rows:
        for i in range(last - first):
            bins[base + i // per].append((at + i % per * length, length))
        ranks[length].append((first, last))
    return bins, ranks


def one_by_one(counts, capacity):
    """Best-fit decreasing, item by item."""
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 9), max_size=25))
def test_plan(counts):
    bins, ranks = expand(packing.plan(counts, 60))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 60
    for n, c in counts.items():
        at = 0
        for first, last in sorted(ranks[n]):
            assert first == at
            at = last
        assert at == c
    assert len(bins) <= one_by_one(counts, 60) + 1


def test_rows(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "a b c", "word " * 3000, "x y " * 1023, "hello " * 700, "hello " * 690, "one"] + ["same text"] * 50
    rows = [(i if i != 7 else None, t, 5) for i, t in enumerate(texts)] + [(2, "a b c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.best_fit(docs, PATH, keep_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x, _ in rows)
    by = defaultdict(list)
    for r in got:
        ids = bytes(r.ids)
        assert zlib.crc32(ids) == r.ids_crc32 and len(ids) == 4 * r.length
        by[str(r.doc_id)].append((r.piece, r.start, list(memoryview(ids).cast("I"))))
    for key, ids in want:
        pieces = sorted(by[key])
        if key == "2":
            assert [p[2] for p in pieces] == [ids, ids]
            continue
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum((p[2] for p in pieces), []) == ids
        assert all(len(p[2]) == 2048 for p in pieces[1:]) and (len(pieces) == 1) == (len(ids) <= 2048)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
