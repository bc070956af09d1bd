import numpy as np
import pytest

from scorelake.llm import line_dedup

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, least=10):
    holders = {}
    num = lambda i: 1 << 70 if i is None else i
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(num(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and min(holders[key(x)]) < num(i))]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


ROWS = [
    (1, "A shared line here\nown line number one\n\n"), (2, "  a SHARED line HERE \nshort\nown line number two"), (3, "short\nshort\nA shared line here\nA shared line here"), (4, None), (5, ""), (6, "\n\n"),
    (7, "É shared line\né shared line"), (8, "É shared line"), (None, "own line number one\nonly in the null document"), (None, "only in the null document"), (2, "own line number two\nown line number two"), (9, "x" * 50_000 + "\nown line number one"),
    (10, "exactly 10\nnine char\n\x0bexactly 10\x0c"), (11, "exactly 10\nnine char"),
]


@pytest.mark.parametrize("small", [False, True])
def test_rows(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
        monkeypatch.setattr(line_dedup, "SHARD_PROBES", 10)
    rows = ROWS + [(100 + i, f"a line that very many documents hold\nnumber {i} of the many") for i in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hashes string, n_lines int")
    got = line_dedup.dedup_lines(docs, carry=("hashes",)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute(rows)
    assert {r.hashes for r in got} == {"x"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).count() == 0
    nothing = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(nothing).collect()) == [(1, 1, 0, "a"), (2, 1, 0, "")]


def test_perfect_hash():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    table = line_dedup.PerfectHash.unpacked(line_dedup.PerfectHash.of(keys).packed())
    assert sorted(table.index(keys)) == list(range(len(keys)))
    assert len(table.index(keys[:0])) == 0 and line_dedup.PerfectHash.of(keys[:0]).size == 0


def test_keys_that_agree_in_one_hash(spark):
    keys = spark.createDataFrame([(0, 7, 1, 2, 5), (0, 7, 2, 1, 6), (0, 7, 3, 2, 4), (0, 8, 1, 2, 9)], "shard long, h long, check int, n int, first long")
    shards = line_dedup.build_shards(keys).selectExpr("*", "0 as copy")
    asked = [(6, 7, 1), (5, 7, 1), (7, 7, 2), (4, 7, 3), (5, 7, 3), (10, 8, 1), (10, 8, 2), (10, 9, 1)]
    probes = spark.createDataFrame([(0, 0, doc, 0, h, check) for doc, h, check in asked], "shard long, copy int, doc long, row long, h long, check int")
    assert sorted((r.doc, r.h, r.check) for r in line_dedup.probe(shards, probes).collect()) == [(5, 7, 3), (6, 7, 1), (10, 8, 1)]


def test_hashes_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    lines = ["x" * n + " É中 Tail" for n in range(0, 200, 7)]
    docs = spark.createDataFrame([(x,) for x in lines], "text string")
    for r in docs.select("text", line_dedup._hashes(F.col("text"), 1).alias("h")).collect():
        assert line_dedup.without(r.text, {tuple(r.h[0])}, 1) == (1, 0, "")
        assert line_dedup.without(r.text, {(r.h[0].h, r.h[0].check ^ 1)}, 1) == (1, 1, r.text)


def test_rows_without_id_are_apart(spark):
    rows = [(1, "a line of document one")] + [(None, f"a line of document one\nown line of row {i}") for i in range(50)] + [(None, "shared by rows without id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect()) == brute(rows)
    assert line_dedup.repeated_lines(docs).filter("size(hashes) > 1").count() == 0
