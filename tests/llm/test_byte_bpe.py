import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "a <|endoftext|> b<|endoftext|>", "I'll say 'so' \n\n\n  x\t\ty ", "é中文 ３½ \U0001f600‍ ｶﾞ", "x" * 30000, "the the the\n" * 4000, "''s 're'RE 12345 $$$ %%%    z", "\x00\x01\x7f",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "x"), (None, "null id", None)]
    got = byte_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    t = library()
    want = {(i, x or ""): t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = want[r.doc_id, r.decoded]
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()


def test_empty_table(spark):
    assert byte_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = byte_bpe.coder(PATH).encode(text)
    assert list(memoryview(ids).cast("I")) == library_once().encode(text, add_special_tokens=False).ids
    assert byte_bpe.coder(PATH).encode_fast(text) == ids
    assert byte_bpe.coder(PATH).decode(ids) == text


def library_once(cached=[]):  # noqa: B006
    if not cached:
        cached.append(library())
    return cached[0]


def test_table_starts_afresh(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 5)
    bpe = byte_bpe.ByteBpe(PATH)
    for text in ["a b c d", "a b x y z", "a b c d e f g", "a b x y z"]:
        assert list(memoryview(bpe.encode(text)).cast("I")) == library_once().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("special", ["<|endoftext|>"])
def test_special(special):
    assert list(memoryview(byte_bpe.coder(PATH).encode(special * 2)).cast("I")) == [50256] * 2


def test_fast_is_used():
    bpe = byte_bpe.coder(PATH)
    assert bpe.ranked is not None
    for text in TEXTS[1:]:
        assert bpe.encode_fast(text) == bpe.encode(text)


def test_small_blocks_and_each_word_once(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 40)
    texts = [t for t in TEXTS if t is None or len(t) < 1000] + [f"word{i % 7} and some more of them \U0001f600\n" * (i % 4) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = byte_bpe.blocks(docs, PATH, 5).collect()
    held = [r for r in rows if r.key == r.block]
    assert len(held) > 20 and len({r.block for r in held}) == len(held)
    assert sorted(i for r in held for i in r.ids) == list(range(len(texts)))
    words = [(r.block, int(n), w.as_py(), r.key) for r in rows if r.key < byte_bpe.FIRST_BLOCK for n, w in zip(*byte_bpe.unpacked_words(bytes(r.data)), strict=True)]
    assert len({(b, w) for b, _, w, _ in words}) == len({(b, n) for b, n, _, _ in words}) == len(words)  # a word once in each block
    assert len({w for _, _, w, _ in words}) == len({(w, k) for _, _, w, k in words})  # and in one part
    of = {(b, n): w for b, n, w, _ in words}
    by_id = dict(enumerate(texts))
    for r in held:
        numbers = byte_bpe.decoded_numbers(bytes(r.data)).tolist()
        assert "".join(of[r.block, n] for n in numbers) == "".join(by_id[i] or "" for i in r.ids) and sum(r.counts) == len(numbers)
    t = library_once()
    got = {r.doc_id: r for r in byte_bpe.encode_decode(docs, PATH).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(got[i].ids)).cast("I")) == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_each_distinct_word_is_encoded_once(monkeypatch):
    class Counting(byte_bpe.ByteBpe):
        asked: list = []

        def learn(self, words):
            self.asked += words
            return super().learn(words)

    monkeypatch.setattr(byte_bpe, "AT_ONCE", 4)
    words = sorted(["the"] * 11 + ["a", "a", " word", "b"] * 3 + ["zz"])
    batches = [pa.RecordBatch.from_arrays([pa.array([i % 3 for i in range(at, to)]), pa.array(range(at, to), pa.int32()), pa.array(words[at:to])], names=["block", "number", "word"]) for at, to in ((0, 7), (7, 8), (8, len(words)))]
    bpe = Counting(PATH)
    monkeypatch.setattr(byte_bpe, "PACKED", 6)
    found = pa.Table.from_batches(list(byte_bpe.encoded(batches, bpe)))
    assert bpe.asked == sorted(set(words))
    got = {}
    for block, data in zip(found.column("key").to_pylist(), found.column("data").to_pylist(), strict=True):
        numbers, lengths, ids = byte_bpe.unpacked_ids(data)
        for n, own in zip(numbers.tolist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            got[block, n] = own.tolist()
    assert got == {(i % 3, i): library_once().encode(w, add_special_tokens=False).ids for i, w in enumerate(words)}


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for numbers in (np.zeros(0, np.int64), np.arange(600), rng.integers(0, 300, 1000), np.array([254, 255, 256, 1 << 24, (1 << 32) + 254])):
        assert byte_bpe._spread(byte_bpe._squeezed(numbers)).tolist() == numbers.tolist()


def test_words_of_the_library():
    bpe = byte_bpe.ByteBpe(PATH)
    for text in TEXTS[1:]:
        plain = text.replace("<|endoftext|>", "")
        want = [plain[i:j] for _, (i, j) in bpe.library.pre_tokenizer.pre_tokenize_str(plain)]
        assert bpe.split(plain) == want and "".join(bpe.split(text)) == text


def test_decode_by_a_join(spark):
    ids = {i: library_once().encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS[2:])}
    tokens = spark.createDataFrame([(i, n, x) for i, own in ids.items() for n, x in enumerate(own)] + [(99, 0, None), (99, 1, 10**6)], "doc int, position int, id long")
    got = {r.doc: r.decoded for r in byte_bpe.decode(tokens, PATH, ["doc"]).collect()}
    assert got == {i: t for i, t in enumerate(TEXTS[2:])} | {99: ""}


def test_input_from_a_shuffle(spark, tmp_path):
    """Behind a shuffle rows may come in another order when a task runs again; then the input is a table of its own, and a stored one is read as it is."""
    from pyspark.sql import functions as F

    from scorelake.llm.common import settled

    rows = [(i, f"the cat {i} sat {'on' * (i % 3)} the mat") for i in range(300)]
    dealt = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # the order within a partition is another each time that it is read
    unsteady = dealt.withColumn("r", F.rand()).sortWithinPartitions("r").drop("r")
    held = settled(unsteady)
    assert held.collect() == held.collect() and "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.decoded for r in byte_bpe.encode_decode(unsteady, PATH).collect()}
    assert got == dict(rows)
    dealt.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert settled(stored) is stored
