"""Treebank tokens by hand, and the same rules in SQL on odd texts."""

import random

import duckdb
from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.operators import captions
from scorelake.plans.views import _treebank_sql

CASES = {
    "A man's dog can't run.": "a man 's dog ca n't run",
    "They don't; we'll see, won't we?": "they do n't we 'll see wo n't we",
    'He said, "It cannot be!"': "he said it can not be",
    "“It’s fine,” she said…": "it 's fine she said",
    "Mr. J. Smith lives in the U.S. now.": "mr. j. smith lives in the u.s. now",
    "It costs $1,234.50 (about 3%) at 10:30, e.g. here.": "it costs $ 1,234.50 about 3 % at 10:30 e.g. here",
    "a well-known man -- or woman - runs...": "a well-known man or woman runs",
    "'Tis gonna rain, 'twas wet": "'t is gon na rain 't was wet",
    "the dogs' 'quoted word'.": "the dogs quoted word",
    "tom&jerry #1 a@b": "tom & jerry # 1 a @ b",
    "[one] {two} <three>": "one two three",
    "one,two,,three: four,": "one two three four",
    "etc. etc.. end.'": "etc. etc end",
    "Ünïcode wörds, naïve!": "ünïcode wörds naïve",
    "": "",
    " \t\n": "",
    "... -- ' \" . ,": "",
    None: "",
}


def test_by_hand(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id long, t string")
    got = {r.id: " ".join(r.w) for r in rows.select("id", text.treebank(F.col("t")).alias("w")).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_same_as_sql(spark):
    rng = random.Random(3)
    bits = ["cannot", "n't", "'s", "'", '"', ".", "..", "u.s.", "dr.", ",", ":", "5", "1,000", "a", "dog", "--", "-", " ", " ", "  ", "\n", "$", "gonna", "'tis", "é", "’", "“", "(", "]", "'ll", "d'ye", "…"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + list(CASES)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = dict(con.sql(f"SELECT id, {_treebank_sql('t')} FROM t").fetchall())
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {r.id: r.w for r in rows.select("id", text.treebank(F.col("t")).alias("w")).collect()} == want


def test_suite(spark):
    rows = spark.createDataFrame([("v", "1", "A dog's bone.", "a dog 's bone"), ("v", "2", '"Two" birds, flying!', "two birds flying")], "video string, pair string, prediction string, reference string")
    got = captions.caption_suite(rows, "video", "pair", split=text.treebank).first()  # tokens of tokens are the same
    assert (got.bleu_1, got.bleu_2, got.rouge_l) == (1, 1, 1)
    assert captions.caption_suite(rows, "video", "pair").first().bleu_1 < 1
