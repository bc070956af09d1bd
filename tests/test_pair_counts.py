"""N-gram counts of pairs against plain Python, and words' Treebank tokens against those of whole texts."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_treebank import CASES

from scorelake.functions import text
from scorelake.operators import captions


def _rows():
    rng = random.Random(5)
    bits = ["cannot", "n't", "'s", "'", '"', ".", "..", "u.s.", "dr.", ",", ":", "5", "1,000", "a", "dog", "--", "-", " ", " ", "  ", "\n", "$", "gonna", "'tis", "é", "’", "“", "(", "]", "'ll", "d'ye", "…", "a b "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + list(CASES)
    return [(i % 3, i, t, texts[(i * 7 + 1) % len(texts)] if i % 4 else t) for i, t in enumerate(texts)]


def _want(a, b):
    out = []
    for n in (1, 2, 3, 4):
        x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
        out += [(x & y).total(), x.total(), y.total()]
    return out


def test_counts(spark, monkeypatch):
    rows = spark.createDataFrame(_rows(), "g int, id long, p string, r string")
    for split, size in ((text.treebank, 1 << 21), (text.plain_words, 50), (lambda c: F.split(c, "a"), 1)):
        monkeypatch.setattr(captions, "SLICE", size)
        told = F.coalesce(F.col("p"), F.lit("")), F.coalesce(F.col("r"), F.lit(""))
        if split not in (text.treebank, text.plain_words):
            split = lambda c: F.split(F.regexp_replace(text.normalise(c), " ", ""), "a")
        words = {x.id: _want([w for w in x.a], [w for w in x.b]) for x in rows.select("id", split(told[0]).alias("a"), split(told[1]).alias("b")).collect() if split in (text.treebank, text.plain_words) or (x.a != [""] and x.b != [""])}
        got = {x.id: [x[c] for c in captions.COUNTS] for x in captions.pair_counts(rows, ["id"], "p", "r", split).collect()}
        assert len(got) == rows.count() and len(words) > 300
        assert {i: got[i] for i in words} == words


def test_corpus_bleu_shuffles_sums_alone(spark):
    rows = spark.createDataFrame(_rows(), "g int, id long, p string, r string")
    plan = captions.corpus_bleu(rows, "g", "id", "p", "r", text.treebank)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
