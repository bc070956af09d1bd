import re
import zlib

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from scorelake.llm import byte_bpe, language_id, secret_scan
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near
from test_secret_scan import link

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = [(900_001, None, "en", "s", 0), (900_002, "12345 !!", "en", "s", 8), (900_003, "", None, None, None), (900_004, "中文中文中文", "en", "s", 6)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).union(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(900_005).cast("long")))
    columns = docs.columns
    named = dict(cp.STAGES)
    one = named["language_id"](spark, docs, DIR).cache()
    assert one.columns == columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {900_001, 900_002, 900_003, 900_004}

    two = named["line_dedup"](spark, one, DIR).cache()
    assert two.columns == columns
    want = {int(i): t for i, _, n, t in brute_lines([(r.doc_id, r.text) for r in one.collect()]) if not (n and not t.strip(" \t\n\x0b\x0c\r"))}
    assert {r.doc_id: r.text for r in two.collect()} == want and all(r.n_chars == len(r.text) for r in two.collect())
    assert 900_005 not in want  # a copy has lost all its lines

    three = named["near_dedup"](spark, one, DIR).cache()  # on documents that still have their copies
    assert sorted(r.doc_id for r in three.collect()) == [i for i, _, _, first in brute_near([(r.doc_id, r.text) for r in one.collect()], 5, 80) if first]
    assert three.columns == columns

    four = named["secret_scan"](spark, three, DIR).cache()
    assert four.columns == columns and four.count() == three.count()
    assert secret_scan.digest(four).filter("spans <> ''").count() == 0
    before = {r.doc_id: r.text for r in three.collect()}
    changed = [r for r in four.collect() if r.text != before[r.doc_id]]
    assert changed and all("[SECRET]" in r.text for r in changed)
    assert not any(re.search("AKIA[A-Z0-9]{14}", r.text) for r in four.collect())

    five = named["best_fit_packing"](spark, four, DIR)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(five.columns)


def test_run(spark):
    got = cp.run(spark, DIR)
    assert got.count() > 100
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert filled.filter("n > 2048").count() == 0
    assert filled.count() <= got.agg(F.sum("length")).first()[0] / 2048 * 1.1 + 1


def test_empty(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, DIR).count() == 0, name


def test_nothing_is_rejected_that_is_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert cp.identify(spark, docs, "").count() == docs.count()
    assert language_id.NONE == "und"


def test_near_duplicates_by_row(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    rows = [(3, text("a")), (None, text("a") + " x"), (None, text("alone")), (None, text("b")), (5, text("c")), (8, text("d")), (None, text("c") + " y"), (None, text("d") + " y")]
    rows += [(9, text("e")), (9, text("e")), (4, text("f")), (4, text("g")), (7, text("f") + " z"), (6, text("g")), (2, text("g") + " z"), (None, text("h")), (None, text("h"))]
    docs = spark.createDataFrame([(*r, None, 0) for r in rows], "doc_id long, text string, row string, doc int")
    got = cp.drop_near_duplicates(spark, docs, "")
    want = [(3, "a"), (None, "alone"), (None, "b"), (5, "c"), (8, "d"), (9, "e"), (4, "f"), (None, "h")]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(i, text(w)) for i, w in want] + [(2, text("g") + " z")], key=str)


def test_documents_without_languages_stay(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bare = docs.withColumn("lang", F.lit(None).cast("string")).union(spark.createDataFrame([(900_001, None, None, "s", 0), (900_002, "12345 !!", None, "s", 8)], docs.schema))
    got = cp.identify(spark, bare, "")
    assert got.columns == docs.columns and {r.lang for r in got.collect()} == {language_id.NONE}
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    # a language of which too little is known to have n-grams explains nothing
    few = spark.createDataFrame([(1, "Ab", "en", "s", 2), (2, "cd", None, "s", 2), (3, "7", None, "s", 1)], docs.schema)
    assert sorted(r.doc_id for r in cp.identify(spark, few, "").collect()) == [1, 2]


def hidden(text):
    """The text with each secret, and what overlaps it, replaced."""
    out, at = [], 0
    for start, _, end in link(text, secret_scan.REACH):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_run_against_brute_force(spark):
    """The pipeline's pieces are those of the texts that brute-force versions of its stages leave, in sequences without gaps."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in cp.identify(spark, docs, DIR).collect()]
    rows = [(int(i), t) for i, _, n, t in brute_lines(rows) if not (n and not t.strip(" \t\n\x0b\x0c\r"))]
    first = {i for i, _, _, kept in brute_near(rows, 5, 80) if kept}
    bpe = byte_bpe.coder(cp.TOKENIZER)
    want = {}
    for i, text in rows:
        if i in first:
            ids = bpe.library.encode(hidden(text), add_special_tokens=False).ids + [0]
            head = len(ids) % cp.CAPACITY
            want[i] = ids, head
    got = {}
    for r in cp.run(spark, DIR).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    placed = {}
    for i, pieces in got.items():
        ids, _ = want[i]
        at = 0
        for r in sorted(pieces, key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
            placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > cp.CAPACITY)
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cp.CAPACITY


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows(spark, name):
    """Null ids and texts, repeated rows and clashing names, in each stage alone: no stage fails, and those that filter keep what is clean."""
    text = lambda word: "\n".join(f"{word} line of the text number {word}{i}, with words" for i in range(8))
    rows = [(1, text("alpha")), (None, text("beta")), (None, text("gamma")), (2, None), (3, ""), (4, text("delta")), (4, text("delta")), (5, "token=abcdefghijklmnop " + text("omega")), (6, "x" * 60_000), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "a", 2, "b", 3.0, 4, 5, 6, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, found string, row int, lang_pred string, score double, h int, n_lines int, n_dropped int, kept_text string")
    got = dict(cp.STAGES)[name](spark, docs, "")
    if name == "best_fit_packing":
        assert got.groupBy("doc_id").count().count() == 7 and got.filter("doc_id is null").count() >= 3
        return
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    clean = [(1, text("alpha")), (None, text("beta")), (None, text("gamma"))]
    assert all(kept.count(x) == 1 for x in clean)
    assert kept.count((4, text("delta"))) == (1 if name == "near_dedup" else 2)
    if name == "secret_scan":
        assert len(kept) == len(rows) and any("[SECRET]" in (t or "") for _, t in kept)
