import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions import parse
from scorelake.operators import dense, intervals

SCHEMA = "video string, idx int, span struct<start:double,end:double>"


def table(spark, rows):
    as_double = lambda s: None if s is None else tuple(None if x is None else float(x) for x in s)
    return spark.createDataFrame([(v, i, as_double(s)) for v, i, s in rows], SCHEMA)


def spans(n, seed, videos=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = rng.choice([0, 1, 63.9, 64, 128, -70, 1e6, rng.random() * 500, 1e14, -1e300])
        length = rng.choice([0, 0.1, 5, 64, 64.0001, 1000, 1e6, 1e14, 2e300, rng.random() * 300])
        a, b = (at, at + length) if rng.random() < 0.9 else (at + length, at)
        out.append((f"v{rng.randrange(videos)}", i, (a, b)))
    nan, inf = float("nan"), float("inf")
    return out + [("v0", n + k, s) for k, s in enumerate([None, (None, 1.0), (0.0, None), (nan, 3.0), (0.0, inf), (-inf, inf), (0.0, nan), (-1.7e308, 1.7e308), (1.7e308, -1.7e308)])]


def brute(left, right):
    fine = lambda s: s is not None and all(x is not None and abs(x) < float("inf") for x in s)
    return sorted((v, i, j) for v, i, p in left for w, j, g in right if v == w and fine(p) and fine(g) and p[0] < g[1] and g[0] < p[1])


@pytest.mark.parametrize("unit", [64.0, 0.5])
def test_against_brute_force(spark, unit):
    left, right = spans(150, 1), spans(130, 2)
    left += left[:5]
    met = intervals.meeting(table(spark, left), table(spark, right), ["video"], unit)
    assert sorted((r.video, r.l.idx, r.r.idx) for r in met.collect()) == brute(left, right)


def test_copies_and_candidates(spark):
    """One level for short intervals alone, some for a range of 1e14 s; and short intervals don't meet in a long one's node."""
    short = table(spark, [("v", i, (i * 100.0, i * 100.0 + 9)) for i in range(2000)])
    assert intervals.levels(short, short, 64.0) == [0]
    long = table(spark, [("v", 0, (1.0, 99999999999999.0)), ("v", 1, (5.0, 6.0)), ("v", 2, (1e6, 2e6))])
    assert intervals.levels(short, long, 64.0) == [0, 14, 41]
    both = short.union(long.filter("idx = 0"))
    met = intervals.meeting(both, both, ["video"])
    assert met.count() == 2000 + 1 + 2 * 2000  # each with itself, the long one with all
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("Join Inner") == 1
    joined = met._jdf.queryExecution().optimizedPlan()
    text = plan[plan.index("Join Inner") :].split("\n")[0]
    assert "role" in text and "level" in text and "node" in text and joined is not None


def test_a_caption_of_any_length(spark):
    """Times from a model's text: a job with 1e14 s ends, and with the pairs of all others."""
    said = "1 - 99999999999999 seconds, all of it. 3 - 9 seconds, a cat."
    rows = spark.createDataFrame([("v", said)], "video string, t string").select("video", F.posexplode(parse.timed_captions(F.col("t"))).alias("idx", "c"))
    names = rows.schema["c"].dataType.names
    span = F.struct(F.col(f"c.{names[0]}").alias("start"), F.col(f"c.{names[1]}").alias("end")) if names[0] == "start" else F.col(f"c.{names[0]}")
    pred = rows.select("video", "idx", span.alias("span"), F.col(f"c.{names[-1]}").alias("sentence"))
    gold = spark.createDataFrame([("v", 0, (2.0, 9.0), "a cat")], SCHEMA + ", sentence string")
    assert sorted((r.pred_i, r.ref_i) for r in dense.overlaps(pred, gold).collect()) == [(0, 0), (1, 0)]
    got = {round(r.tau, 1): (r.precision, r.recall) for r in dense.detection(pred, gold).collect()}
    assert got[0.5] == (0.5, 1.0) and len(got) == 4
    assert [r.pred_i for r in dense.unmatched(pred, gold, 0.5).collect()] == [0]


def test_empty(spark):
    none, some = table(spark, []), table(spark, spans(5, 3))
    assert intervals.meeting(none, some, ["video"]).count() == intervals.meeting(some, none, ["video"]).count() == intervals.meeting(none, none, ["video"]).count() == 0
