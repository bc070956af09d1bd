import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.functions import jsons, parse, temporal, text


def values(spark, rows, column, schema="t string"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r.v for r in frame.coalesce(1).select(column.alias("v")).collect()]


def plain(x):
    if isinstance(x, list):
        return [plain(y) for y in x]
    return [plain(y) for y in x] if hasattr(x, "asDict") else x


SPANS = {
    "The event happens from 10.5 - 20 seconds": [[10.5, 20]], "30-12": [[12, 30]], "from 3 to 9.5 seconds": None, "from 3  to  9.5 seconds": [[3, 9.5]], "1 - 2 and 5.0-6.5": [[1, 2], [5, 6.5]], "It starts at 4.5 and ends at 7": [[4.5, 7]], "It starts at 4": None, "between 3 and 5": None,
    "None seen": None, "1..5 - 3": None, "": None, "It starts at 4! it ends at 9? other 3": [[4, 9]],
}


def test_time_spans(spark):
    wanted = dict(SPANS)
    wanted["from 3 to 9.5 seconds"] = [[3, 9.5]]
    assert [plain(v) for v in values(spark, list(wanted), parse.time_spans(F.col("t")))] == list(wanted.values())


def test_first_number(spark):
    cases = {"around 12.5 s": 12.5, "at -3 sec": -3, ".75": 0.75, "none": None, "": None, None: None, "3. 4": 3}
    assert values(spark, list(cases), parse.first_number(F.col("t"))) == list(cases.values())


def test_letters(spark):
    assert values(spark, ["(B) foo", "x (c)", "d", "", None], parse.bracketed_letter(F.col("t"))) == ["b", "c", None, None, None]
    assert values(spark, ["Best Option: (C) x", "d", "a. foo", "", "  ( ", "word", None], parse.leading_letter(F.col("t"))) == ["c", "d", "a", "", "", None, None]
    cases = [("(B) x", "b", True, False), ("(A) x", "b", False, False), ("(A) b", "b", False, False), ("b) x", "b", True, False), ("", "b", False, True), ("word", "b", False, True)]
    got = values(spark, [c[:2] for c in cases], parse.choice(F.col("t"), F.col("g")), "t string, g string")
    assert [(r.hit, r.failed) for r in got] == [c[2:] for c in cases]


def test_timed_captions(spark):
    cases = {
        "0 - 5 seconds, A man walks. 6-9 seconds: He sits down": [[[0, 5], "a man walks."], [[6, 9], ": he sits down"]],
        "at 30 seconds the dog barks loudly\nAt 5 seconds, it runs": [[[10, 50], "the dog barks loudly"], [[5, 45], ", it runs"]],
        "from 3 and 8 seconds they talk. Nothing": [[[3, 8], "they talk."]],
        "no times here": None, "": None, None: None,
    }
    assert [plain(v) for v in values(spark, list(cases), parse.timed_captions(F.col("t")))] == list(cases.values())


def test_yes_no(spark):
    cases = {"Yes, it is": "Yes.", "NO": "No.", "Nothing": "No.", "Maybe": None, None: None}
    assert values(spark, list(cases), text.answer_prefix(F.col("t"))) == list(cases.values())
    assert values(spark, ["**Yes** because", "*no*", "I think yes"], text.judge_prefix(F.col("t"))) == ["yes", "no", None]
    cases = {"That is correct": True, "incorrect": False, "yes and no": True, "unclear": None, "éno": None, "": None, "It is false.": False}
    assert values(spark, list(cases), text.yes_no(F.col("t"))) == list(cases.values())
    odd = [("yes (", "yes"), ("[", "["), ("*", "*"), ("a|b", "B"), ("x{2", "x"), (None, "no"), ("\\", "a"), ("yes)|(no", "no"), ("c++", "c++"), ("é", "É é")]
    assert values(spark, odd, text.has_word(F.col("t"), F.col("r")), "r string, t string") == [None, None, None, True, None, False, None, None, True, True]
    assert values(spark, [("no", "No, not really"), ("no", "nothing"), ("no", None)], text.has_word(F.col("t"), F.col("r")), "r string, t string") == [True, False, False]


def test_text(spark):
    assert values(spark, ["  A \t\n b ", None, ""], text.normalise(F.col("t"))) == ["a b", "", ""]
    assert values(spark, ["a b c", "", "a"], text.ngrams(text.words(F.col("t")), 2)) == [["a b", "b c"], [], []]
    assert values(spark, ["```json\n{1}\n```", "```\nx```", "plain", " a "], text.strip_fences(F.col("t"))) == ["{1}", "x", "plain", "a"]
    assert values(spark, ["a_b_c", "abc"], text.split_last(F.col("t"))) == [("a_b", "c"), ("abc", None)]
    assert values(spark, ["/x/y.tar.gz", "name", "/a/.b"], text.stem_of_path(F.col("t"))) == ["y.tar", "name", ".b"]
    assert values(spark, ["é\"", "b"], text.single_quoted(text.ascii_only(F.col("t")))) == [" '", "b"]
    assert values(spark, [0.1234], text.percent(F.col("t")), "t double") == ["12.3%"]
    assert values(spark, [("", " ", "x"), (None, "y", "x"), (None, None, None)], text.first_truthy(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string") == ["x", "y", None]
    score = values(spark, ["a man sitting on a chair near a dog", "", None], text.scene_score(F.col("t")))
    # nine words, three objects, and on, in (within sitting), near and sitting
    assert score == pytest.approx([0.3 * 9 / 50 + 0.4 * 3 / 10 + 0.3 * 4 / 5, 0, 0])
    assert values(spark, ["[Content filtered by x]", "CONTENT_FILTER", None], text.is_filtered(F.col("t"))) == [True, False, False]
    assert values(spark, ["[Content filtered by x]", "CONTENT_FILTER", None], text.audit_filtered(F.col("t"))) == [True, True, False]


def test_json(spark):
    cases = {'{"winner": "A"}': ("A", 3.0, "ok"), '```json\n{"winner": "tie", "confidence": 5, "reason": "r", "scores": {"response_a": {"x": 1}}}\n```': ("tie", 5.0, "ok"), '{"winner": "C"}': ("error", None, "error"), "broken": ("error", None, "error"), None: ("error", None, "error")}
    assert [(v.winner, v.confidence, v.status) for v in values(spark, list(cases), jsons.verdict(F.col("t")))] == list(cases.values())
    cases = {'{"winner": "Model A", "confidence": 0.9}': ("Model A", 0.9, "ok"), "bad": ("Tie", 0.0, "parse_error"), '{"winner": "Model B"}': ("Tie", 0.0, "parse_error"), '{"winner": "x", "confidence": 1}': ("Tie", 1.0, "ok")}
    assert [(v.winner, v.confidence, v.status) for v in values(spark, list(cases), jsons.pairwise(F.col("t")))] == list(cases.values())
    cases = {'{"events": [" a ", "", "b"]}': ["a", "b"], "{'events': ['x']}": ["x"], '"events": ["y"]': ["y"], "```json\n{\"events\": []}\n```": [], "nothing": None}
    assert values(spark, list(cases), jsons.events(F.col("t"))) == list(cases.values())
    got = values(spark, ['{"events": [{"event": "e", "relationship": "entailment", "reason": "r"}]}'], jsons.relations(F.col("t")))
    assert got[0][0].relationship == "entailment"


def test_temporal(spark):
    frame = spark.createDataFrame([(0.0, 10.0, 5.0, 15.0), (0.0, 1.0, 2.0, 3.0), (1.0, 1.0, 1.0, 1.0), (0.0, 4.0, 0.0, 4.0)], "a double, b double, c double, d double")
    x, y = temporal.segment(F.col("b"), F.col("a")), temporal.segment(F.col("c"), F.col("d"))
    got = frame.coalesce(1).select(temporal.iou(x, y).alias("i"), temporal.hull_iou(x, y).alias("h")).collect()
    assert [r.i for r in got] == pytest.approx([1 / 3, 0, 0, 1]) and [r.h for r in got] == pytest.approx([1 / 3, 0, 0, 1])
    assert values(spark, [(0.0, 1.0), (0.5, 1.0)], temporal.f1(F.col("r"), F.col("p")), "r double, p double") == pytest.approx([0, 2 / 3])
    assert values(spark, ["5.09", "00:02", "01:00:05", "x", None], temporal.clock_seconds(F.col("t"))) == [5.09, 2, 3605, None, None]
    assert values(spark, [9, 3, 0], temporal.linspace_frames(F.col("t"), 5), "t int") == [[0, 2, 4, 6, 8], [0, 1, 2], []]
    assert values(spark, [9], temporal.stride_frames(F.col("t"), 4), "t int") == [[0, 2, 4, 6]]
    assert values(spark, [8], temporal.rounded_frames(F.col("t"), 5), "t int") == [[0, 2, 4, 5, 7]]
    spans = F.array(temporal.segment(F.lit(0.5), F.lit(2.5)), temporal.segment(F.lit(-3.0), F.lit(1.0)), temporal.segment(F.lit(998.6), F.lit(2000.0)))
    assert sorted(values(spark, ["x"], temporal.slots(spans))[0]) == [0, 1, 999]
    assert values(spark, [(1024, 768), (100, 50)], temporal.fitted(F.col("w"), F.col("h")), "w int, h int") == [(512, 384), (100, 50)]
    assert values(spark, ["x"], temporal.cache_key(F.lit("m"), F.lit("d"), F.lit("{}"))) == ["m_d_99914b93"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.floats(0, 100)] * 4), min_size=1, max_size=30))
def test_iou_properties(spark, rows):
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    x, y = temporal.segment(F.col("a"), F.col("b")), temporal.segment(F.col("c"), F.col("d"))
    for r in frame.select(temporal.iou(x, y).alias("p"), temporal.iou(y, x).alias("q")).collect():
        assert abs(r.p - r.q) < 1e-9 and -1e-9 <= r.p <= 1 + 1e-9
