"""Caption scores of groups on both sides of GROUP, and what their plan makes of n-grams."""

import random

import pytest
from test_caption_scores import suite

from scorelake.operators import captions


def _rows():
    rng = random.Random(9)
    say = lambda: " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(0, 7)))
    sizes = {"large": captions.GROUP + 90, "full": captions.GROUP, "two": 2, "one": 1}
    return [(g, f"{g}{i}", say(), say()) for g, n in sizes.items() for i in range(n)]


def test_groups_of_any_size(spark):
    rows = _rows()
    frame = spark.createDataFrame([*rows, ("two", "none", None, "a b"), ("two", "nor", "a b", None)], "video string, pair string, prediction string, reference string")
    got = {r.video: r.asDict() for r in captions.caption_suite(frame, "video", "pair").collect()}
    assert set(got) == {r[0] for r in rows}
    for group in got:
        for name, value in suite([r[2:] for r in rows if r[0] == group]).items():
            if group != "two" or not name.startswith("bleu"):  # a null text counts as empty for BLEU and has no other score
                assert got[group][name] == pytest.approx(value, abs=2e-6), (group, name)


def test_ngrams_of_large_groups_alone_are_rows(spark):
    """The generators that are left are those of cider_d, behind the join that leaves small groups out."""
    frame = spark.createDataFrame(_rows(), "video string, pair string, prediction string, reference string")
    plan = captions.caption_suite(frame, "video", "pair")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 4 and "LeftSemi" in plan and plan.count("MapInArrow") == 1
