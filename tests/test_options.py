"""The best option for each row, against a plain search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators.options import nearest_option

ROWS, OPTIONS = "id long, x array<double>, i string", "label long, v array<double>"


def brute(rows, options):
    out = []
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    for i, x, _ in rows:
        best = None
        for label, v in options:
            if label is None or not fine(x) or not fine(v) or len(x) != len(v):
                continue
            sim = 0.0
            for a, b in zip(x, v, strict=True):
                sim += a * b
            best = max(best or (-math.inf, 0), (round(sim, 9), -label))
        out.append((i, best and -best[1], best and best[0]))
    return sorted(out, key=str)


def test_both_ways(spark):
    rng = random.Random(4)
    whole = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]  # noqa: E731, many ties
    real = lambda n=3: [rng.uniform(-1, 1) for _ in range(n)]
    options = [(k, whole()) for k in range(300)] + [(k, real()) for k in range(300, 900)] + [(k, real(5)) for k in range(40)] + [(1, None), (2, [1.0, None, 3.0]), (3, [float("nan")] * 3), (None, [9.0, 9.0, 9.0]), (4, [float("inf"), 0.0, 0.0]), (5, [])]
    options += options[:200]  # repeated options
    options += [(2**60 + k, [5.0 + k, 0.0, 0.0]) for k in range(3)]
    options += [(2000 - k, [0.3, 0.3 + k * 1e-12, 0.3]) for k in range(50)]  # products that agree to the last digit told
    rows = [(k, whole(), "a") for k in range(150)] + [(150 + k, real(), None) for k in range(150)] + [(400 + k, real(5), "b") for k in range(20)]
    rows += [(500, None, "c"), (501, [1.0, None, 1.0], "c"), (502, [float("nan"), 0.0, 0.0], "c"), (503, real(4), "c"), (504, [1.0, 1.0, 1.0], "d"), (504, [1.0, 1.0, 1.0], "d"), (505, [-0.0, 0.0, 0.0], "e"), (None, [2.0, 2.0, 2.0], "f"), (506, [], "g")]
    want = brute(rows, options)
    left, right = spark.createDataFrame(rows, ROWS), spark.createDataFrame(options, OPTIONS)
    for sent, block in ((1 << 18, 2048), (0, 100), (0, 7), (0, 5000)):
        got = nearest_option(left, "x", right, "label", "v", sent, block)
        assert got.columns == ["id", "x", "i", "choice", "sim"]
        found = sorted(((r.id, r.choice, r.sim) for r in got.collect()), key=str)
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert [f[2] for f in found] == pytest.approx([w[2] for w in want], abs=1e-9)
    for sent in (1 << 18, -1):
        none = nearest_option(left, "x", right.limit(0), "label", "v", sent, 100)
        assert none.count() == len(rows) and none.filter("choice is not null").count() == 0
        assert nearest_option(left.limit(0), "x", right, "label", "v", sent, 100).count() == 0


def test_many_options(spark):
    """100,000 options: nothing but their blocks meets the rows, and no plan holds them in one row."""
    many = spark.range(100_000).select(F.col("id").alias("label"), F.array(F.cos(F.col("id") * 1e-4), F.sin(F.col("id") * 1e-4)).alias("v"))
    rows = spark.range(300).select("id", F.array(F.cos(F.col("id") * 0.02), F.sin(F.col("id") * 0.02)).alias("x"))
    got = nearest_option(rows, "x", many, "label", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "collect_list" not in plan and "MapInArrow" in plan
    for r in got.collect():  # to nine digits, angles within 3e-5 of the nearest are equal, and the smallest id wins
        assert 0 <= r.id * 200 - r.choice <= 1 and r.sim == pytest.approx(1, abs=1e-8)
