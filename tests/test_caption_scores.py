"""Caption scores against plain Python versions of their definitions."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorelake.functions.porter import stem
from scorelake.operators import captions, dense
from scorelake.plans import views

DIR = "/root/testdata/sf0.001"


def words(text):
    return text.lower().split()


def grams(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def stems(text):
    plain = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return [stem(w) if len(w) > 3 else w for w in plain.split()]


def f(hit, a, b):
    return 2 * hit / (a + b) if hit else 0.0


def suite(pairs):
    """The scores of one group of (prediction, reference)."""
    pairs = [(words(p), words(r)) for p, r in pairs]
    out = {}
    c, r = sum(len(p) for p, _ in pairs), sum(len(q) for _, q in pairs)
    penalty = 1.0 if c >= r else math.exp(1 - r / c) if c else 0.0
    logs, some = 0.0, True
    for n in range(1, 5):
        hit = sum(sum((grams(p, n) & grams(q, n)).values()) for p, q in pairs)
        total = sum(sum(grams(p, n).values()) for p, _ in pairs)
        some = some and hit > 0
        logs += math.log(hit / total) if some else 0
        out[f"bleu_{n}"] = penalty * math.exp(logs / n) if some else 0.0
    rouge, cider, sim = [], [], []
    df = {n: Counter(g for _, q in pairs for g in grams(q, n)) for n in range(1, 5)}
    for p, q in pairs:
        n = common(p, q)
        a, b = (n / len(p), n / len(q)) if n else (0, 0)
        rouge.append((1 + 1.44) * a * b / (b + 1.44 * a) if n else 0.0)
        cosines = []
        for k in range(1, 5):
            idf = lambda g, k=k: math.log(len(pairs)) - math.log(max(1, df[k][g]))
            x, y = ({g: m * idf(g) for g, m in grams(t, k).items()} for t in (p, q))
            norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            cosines.append(sum(min(v, y[g]) * y[g] for g, v in x.items() if g in y) / norm if norm else 0.0)
        cider.append(10 * sum(cosines) / 4 * math.exp(-((len(p) - len(q)) ** 2) / 72))
        sim.append(len({*p} & {*q}) / math.sqrt(len({*p}) * len({*q})) if p and q else 0.0)
    return out | {"rouge_l": sum(rouge) / len(pairs), "cider": sum(cider) / len(pairs), "sim": sum(sim) / len(pairs)}


def test_suite(spark):
    pred, gold = views.dense(spark, DIR)
    met = dense.overlaps(pred, gold).filter("iou >= 0.3").select("video", "pred_i", "ref_i")
    side = lambda t, i, name: t.select("video", F.col("idx").alias(i), F.col("sentence").alias(name))
    pairs = met.join(side(pred, "pred_i", "prediction"), ["video", "pred_i"]).join(side(gold, "ref_i", "reference"), ["video", "ref_i"]).withColumn("pair", F.concat_ws("/", "video", "pred_i", "ref_i"))
    rows = [(str(r.video % 5), r.pair, r.prediction, r.reference) for r in pairs.collect()] + [("x", f"x{i}", p, q) for i, (p, q) in enumerate([("a cat on the mat", "the cat on a mat"), ("", "a b"), ("one two three four five", "one two three four five"), ("b", "")])]
    held = {}
    for group, _, p, q in rows:
        held.setdefault(group, []).append((p, q))
    got = {r.video: r.asDict() for r in captions.caption_suite(spark.createDataFrame(rows, "video string, pair string, prediction string, reference string"), "video", "pair").collect()}
    assert set(got) == set(held) and len(held) > 3
    for group, own in held.items():
        for name, value in suite(own).items():
            assert got[group][name] == pytest.approx(value, abs=2e-6), (group, name)


def test_stemmed_rouge(spark):
    rows = views.captions(spark, DIR)
    texts = {r.sample_id: (stems(r.prediction), stems(r.reference)) for r in rows.collect() if len(r.prediction) < 8000}
    got = {r.sample_id: r for r in captions.stemmed_rouge(rows, "sample_id").collect()}
    assert len(texts) > 100
    for i, (a, b) in texts.items():
        p, q = list(zip(a, a[1:], strict=False)), list(zip(b, b[1:], strict=False))
        want = [f(sum((Counter(x) & Counter(y)).values()), len(x), len(y)) for x, y in ((a, b), (p, q))] + [f(common(a, b), len(a), len(b))]
        assert [got[i].rouge1, got[i].rouge2, got[i].rougel] == pytest.approx(want, abs=1e-6)
