import json
import math

import pytest
from pyspark.sql import functions as F

from scorelake import adapters, cli, evaluators
from scorelake.config import Config, scaffold
from scorelake.functions import jsons
from scorelake.functions.porter import stem
from scorelake.operators import answers, captions, dense, events, grounding, judging, report
from scorelake.pipeline import Benchmark
from scorelake.sources import loaders
from scorelake.streaming.win_rates import windowed


def test_goldens(spark):
    """Arithmetic that was published with its counts."""
    tasks = spark.createDataFrame([(0.605,), (0.64,), (0.0,), (12 / 124,), (0.3,), (0.515,), (0.0,)], "acc double")
    assert answers.macro(tasks, "acc").first().acc == 0.30811
    assert round((0.67076 + 0.45661) / 2, 5) in (0.56368, 0.56369)
    micro = lambda rows: answers.micro(spark.createDataFrame(rows, "correct long, total long")).first().acc
    assert micro([(72, 114), (177, 193), (98, 102)]) == 0.84841 and micro([(60, 109), (98, 193), (80, 95)]) == 0.5995
    for a, b, errors, rate in ((45, 2, 3, 0.95745), (36, 10, 4, 0.78261), (43, 4, 3, 0.91489), (35, 12, 3, 0.74468)):
        rows = [("A", True)] * a + [("B", True)] * b + [("error", False)] * errors
        got = judging.win_rates(spark.createDataFrame(rows, "winner string, success boolean")).first()
        assert (got.win_rate_a, got.errors, got.valid) == (rate, errors, a + b)
    rows = [("s", "success", "yes")] * 56 + [("s", "success", "no")] * 19
    got = answers.scene_overall(spark.createDataFrame(rows, "sample_id string, status string, raw_answer string"), "sample_id").first()
    assert (got.clarity, got.yes_rate, got.no_rate) == (1.0, 0.7467, 0.2533)


def test_events(spark):
    rows = [(1, "s", "recall", r) for r in ("entailment", "entailment", "neutral", "contradiction")] + [(1, "s", "precision", r) for r in ("entailment", "entailment", "neutral", "contradiction")] + [(2, None, "recall", "neutral")]
    scores = events.sample_scores(spark.createDataFrame(rows, "sample_id long, source string, side string, relationship string")).orderBy("sample_id").collect()
    assert (scores[0].recall, scores[0].precision, scores[0].f1) == (0.5, 0.75, pytest.approx(0.6)) and scores[1].precision == 1.0 and scores[1].f1 == 0


def test_captions(spark):
    rows = [(1, "the cat sat on the mat today", "the cat sat on the mat today"), (2, "", "x"), (3, None, "x"), (4, "one two three four five", "six seven eight nine ten"), (5, "word", "word")]
    frame = spark.createDataFrame(rows, "id long, prediction string, reference string")
    bleu = {r.id: r.bleu for r in captions.bleu(frame, "id").collect()}
    assert bleu[1] == 1 and bleu[2] == 0 and bleu[4] == 0 and 3 not in bleu and bleu[5] == 0
    cider = {r.id: r.cider for r in captions.cider_lite(frame, "id").collect()}
    assert cider[1] == 1 and cider[2] == 0
    rouge = {r.id: r for r in captions.stemmed_rouge(frame, "id").collect()}
    assert rouge[1].rougel == 1 and rouge[4].rouge1 == 0
    assert captions._common("a b c d e".split(), "x b d e y a".split()) == 3
    summary = captions.score_summary(spark.createDataFrame([(0.5,)], "s double"), "s").first()
    assert (summary.mean, summary.std, summary.num_evaluated) == (0.5, 0.0, 1)


def test_stems():
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "electriciti": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in cases} == cases


def test_adapters(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise adapters.ReplyError(429, "later")
        return "done"

    assert adapters.with_retries(flaky, sleep=lambda s: None) == "done" and len(calls) == 3
    with pytest.raises(ValueError):
        adapters.with_retries(lambda: (_ for _ in ()).throw(ValueError("final")), sleep=lambda s: None)

    def post(url, body, headers, timeout):
        prompt = body["messages"][0]["content"][0]["text"]
        if prompt == "bad":
            raise RuntimeError("content_filter: no")
        if prompt == "worse":
            raise RuntimeError("broken")
        return {"choices": [{"message": {"content": prompt.upper()}}]}

    frame = spark.createDataFrame([(1, ["a", "bad"]), (2, ["worse"]), (3, None)], "id long, prompt array<string>")
    got = {r.id: r.reply for r in adapters.Http("m", post=post).answer(frame).collect()}
    assert got[1][0] == "A" and got[1][1].startswith("[Content filtered") and got[2][0].startswith("[Error") and got[3] == []
    recorded = adapters.Recorded(spark.createDataFrame([(1, "x")], "id long, reply string"), ["id"])
    assert {r.id: r.reply for r in recorded.answer(frame).collect()} == {1: "x", 2: None, 3: None}
    with pytest.raises(KeyError):
        adapters.model_for("unknown", {})


def test_benchmark(spark, tmp_path):
    samples = [{"id": i, "prediction": ["yes", "no"], "reference": ["yes", "no"] if i % 2 else ["yes", "yes"], "task": "t", "source": "s"} for i in range(4)]
    (tmp_path / "p.json").write_text(json.dumps(samples))
    config = Config().merged({"datasets": {"stored": {"type": "generic", "load_predictions_from_file": str(tmp_path / "p.json")}}, "models": {"m": {"type": "http"}}, "evaluators": {"broken": {"type": "broken"}}})
    evaluators.register("broken", lambda samples: (_ for _ in ()).throw(RuntimeError("never works")))
    bench = Benchmark(spark, config, str(tmp_path / "out"))
    got = bench.run(["m"], ["stored"], ["video-hallucer", "broken", "dsg"]).collect()
    value = {(r.evaluator, r.task, r.metric): (r.value, r.error) for r in got}
    assert value["video-hallucer", "t", "both"][0] == 0.5 and value["broken", None, "score"] == (0.0, "never works")
    assert bench.summary().count() == 1
    assert "<table>" in bench.html() and "video-hallucer" in bench.html()


def test_model_run(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images/a.jpg").write_text("x")
    (tmp_path / "annotations.json").write_text(json.dumps([{"image": "a.jpg", "caption": "c"}]))
    config = Config().merged({"datasets": {"mine": {"type": "capability", "data_path": str(tmp_path)}}})
    bench = Benchmark(spark, config, str(tmp_path / "out"))
    assert bench.run(["echo"], ["mine"]).count() == 0
    (row,) = spark.read.parquet(str(tmp_path / "out/predictions")).collect()
    assert row.prediction[0].startswith("You asked") and row.model == "echo" and row.dataset == "mine"


def test_et_bench(spark):
    segment = lambda a, b: [[(float(a), float(b))]]
    rows = [("tvg", "s", "0 - 10", segment(0, 10), None), ("tvg", "s", "none", segment(0, 10), None), ("rar", "s", "(B)", None, 1), ("vhd", "s", "at 5", segment(0, 10), None), ("tem", "s", "0 - 5", segment(0, 10), None), ("gvq", "s", "(A) 0 - 10", segment(0, 10), 0), (None, "s", "x", None, 0)]
    got = {(r.metric, r.task): r.value for r in evaluators.et_bench(spark.createDataFrame(rows, "task string, source string, answer_text string, gt_segments array<array<struct<start:double,end:double>>>, reference_idx int")).collect()}
    assert got["grounding", "tvg"] == 0.5 and got["referring", "rar"] == 1 and got["grounding", "vhd"] == 1 and got["complex", "tem"] == 0.75 and got["complex", "gvq"] == 1
    assert got["OVERALL", None] == pytest.approx((0.5 + 1 + 1 + 0.75 + 1) / 5)


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["list", "evaluators"]) == 0 and "etbench" in capsys.readouterr().out
    assert cli.main(["init", str(tmp_path / "project")]) == 0 and (tmp_path / "project/configs/benchmark.yaml").exists()
    assert cli.main(["validate"]) == 0
    (tmp_path / "v.json").write_text("\n".join(json.dumps({"id": str(i), "verdict": json.dumps({"winner": "AB"[i % 2]})}) for i in range(1, 6)))
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": i, "prediction": "[Content filtered" if i == 5 else name, "source": "x"} for i in range(1, 6 if name == "a" else 7)]))
    out = tmp_path / "compared"
    both = ["compare", "--pred-a", str(tmp_path / "a.json"), "--pred-b", str(tmp_path / "b.json")]
    assert cli.main([*both, "--verdicts", str(tmp_path / "v.json"), "--name-a", "one", "--name-b", "two", "-o", str(out)]) == 0
    assert "A: one, B: two" in capsys.readouterr().out
    (summary,) = spark.read.json(str(out / "summary")).collect()
    assert (summary.model_a, summary.wins_a, summary.wins_b, summary.errors) == ("one", 2, 2, 1) and len(summary.asDict()) == 16
    assert sorted(r.id for r in spark.read.json(str(out / "detailed_results")).collect()) == ["1", "2", "3", "4", "5"]
    with pytest.raises(SystemExit):
        cli.main(both)
    told = F.lit('{"winner": "Model A", "confidence": 0.5}')
    adapters.register_model("fair", lambda c: adapters.Rule(lambda rows: F.transform("prompt", lambda p: told) if rows.schema["prompt"].dataType.simpleString().startswith("array") else told))
    (tmp_path / "c.json").write_text(json.dumps({"models": {"fair": {"type": "fair"}}, "datasets": {"mine": {"type": "capability", "data_path": str(tmp_path)}}}))
    assert cli.main(["--config", str(tmp_path / "c.json"), *both, "--judge", "fair", "--criteria", "detail", "-o", str(out)]) == 0
    assert spark.read.json(str(out / "summary")).first().a_wins == 5
    (tmp_path / "images").mkdir()
    (tmp_path / "images/a.jpg").write_text("x")
    (tmp_path / "annotations.json").write_text(json.dumps([{"image": "a.jpg", "caption": "c", "id": "i"}]))
    assert cli.main(["--config", str(tmp_path / "c.json"), "versus", "echo", "fair", "-d", "mine", "--judge", "fair", "-o", str(out)]) == 0
    assert spark.read.json(str(out / "summary")).first().model_b == "fair"


def test_config(tmp_path):
    config = Config().merged({"models": {"http": {"temperature": 1}}, "datasets": {"new": {"type": "generic", "data_path": "/x", "odd": 1}}})
    for name in ("c.yaml", "c.json"):
        config.save(tmp_path / name)
        again = Config.load(tmp_path / name)
        assert again.model("http").get("temperature") == 1 and again.dataset("new").extra == {"odd": 1} and again.dataset("new").data_path == "/x"
    with pytest.raises(KeyError):
        config.evaluator("nothing")
    assert scaffold(tmp_path / "p")


def test_report(spark):
    cube = spark.createDataFrame([("m", "d", "e", "score", 0.5), ("n", "d", "f", "score", 1.0)], "model string, dataset string, evaluator string, metric string, value double")
    assert sorted(tuple(r) for r in report.pivot(cube).collect()) == [("m", "0.5000", "N/A"), ("n", "N/A", "1.0000")]
    assert "| a " in report.grid([{"a": 1}]) and "&lt;" in report.page("<", [{"a": "<"}], [])
    assert judging.throughput(209.69, 50)["per_minute"] == pytest.approx(14.307, abs=0.001)


def test_win_rates_sum(spark):
    rows = [(c, w, True) for c in ("x", "y") for w in ("A", "B", "tie", "A")]
    for r in judging.win_rates_by_category(spark.createDataFrame(rows, "category string, winner string, success boolean")).collect():
        assert r.a_rate + r.b_rate + r.tie_rate == pytest.approx(1)


def test_localisation_and_summary(spark):
    schema = "task string, source string, pred array<struct<start:double,end:double>>, gold array<struct<start:double,end:double>>"
    frame = spark.createDataFrame([("t", "s", [(0.0, 10.0), (50.0, 60.0)], [(0.0, 10.0)]), ("t", "s", None, [(0.0, 10.0)])], schema)
    assert grounding.localisation(frame).first().f1_50 == pytest.approx(round(2 / 3 / 2, 5))
    assert grounding.summary(frame).first().f1 == pytest.approx(round(2 * 0.5 / 1.5, 5))


def test_stream(spark, tmp_path):
    schema = "ts timestamp, category string, verdict_json string"
    spark.createDataFrame([("2024-01-01 00:01:00", "x", '{"winner": "A"}'), ("2024-01-01 00:02:00", "x", "broken"), ("2024-01-01 02:00:00", "y", '{"winner": "tie"}')], "t string, category string, verdict_json string").select(F.to_timestamp("t").alias("ts"), "category", "verdict_json").write.parquet(str(tmp_path / "in"))
    out = windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("rates").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.category, r.total, r.a_wins, r.ties) for r in spark.table("rates").collect()) == [("x", 2, 1, 0), ("y", 1, 0, 1)]
    assert jsons.DEFAULT_CONFIDENCE == 3


def test_judged_chains(spark):
    from scorelake import judged

    def judge(rows):
        p = F.col("prompt")
        found = F.when(p.contains("List the events"), '{"events": ["one", "two"]}').when(p.contains("entails it"), '{"events": [{"event": "one", "relationship": "entailment"}, {"event": "two", "relationship": "Neutral"}, {"event": "more", "relationship": "entailment"}]}')
        found = found.when(p.contains("which is better"), F.when(p.contains("good"), '{"winner": "A"}').otherwise("no idea")).when(p.contains("mention the following"), F.when(p.contains("cat"), "**Yes**").otherwise("no"))
        found = found.when(p.contains("Name the background"), "1 | cat\nno line").when(p.contains("Give the attributes"), "cat | colour | black\nsky | No mention | x").when(p.contains("Give the relations"), "1 | cat | on | mat").when(p.contains("Turn this line"), F.concat(F.lit("Is it so: "), F.element_at(F.split(p, "\n\n"), -1)))
        return found.when(p.contains("colour"), "unclear").otherwise("Yes, true")

    rule = adapters.Rule(judge)
    rows = [(1, "s", "pred", "ref", None), (2, "s", " ", "ref", None), (3, None, "pred", "ref", ["g1", "g2", "g3"])]
    samples = spark.createDataFrame(rows, "id long, source string, prediction string, reference string, events array<string>")
    got = {r.source: r for r in judged.autodq(samples, rule).collect()}
    assert (got["s"].recall, got["s"].precision, got["s"].failed, got["s"].success) == (0.5, 1.0, 1, 1)
    assert got["UNKNOWN"].recall == pytest.approx(0.66667) and got["OVERALL"].success == 2  # the third of a judge's extra relations meets the third event

    side = lambda rows: spark.createDataFrame(rows, "id string, pos long, source string, text string")
    a, b = side([("1", 0, "x", "good"), ("2", 1, "x", "[Content filtered"), ("3", 2, None, "bad"), ("1", 3, "x", "good")]), side([("1", 0, "x", "b"), ("2", 1, "x", "b"), ("3", 2, "x", "b")])
    got = {r.id: (r.winner, r.success) for r in judged.ranked(a, b, rule).collect()}
    assert got == {"1": ("A", True), "2": ("skipped", False), "3": ("error", False)}

    described = spark.createDataFrame([("t", ["y", "a cat"], ["Yes.", "an animal"]), ("t", ["y", " "], ["Yes.", "z"])], "task string, prediction array<string>, reference_text array<string>")
    assert sorted(r.matched for r in judged.described(described, rule).collect()) == [False, True]
    scene = judged.scene_score(spark.createDataFrame([(1, "a black cat on a mat")], "id long, description string"), rule, rule).first()
    assert (scene.total, scene.n_yes, scene.n_unclear) == (3, 2, 1)


def test_caption_suite(spark):
    rows = [("v", "1", "a man walks a dog in the park", "a man walks a dog in the park"), ("v", "2", "two birds fly over the lake now", "two birds flying over a lake"), ("w", "3", "nothing here", "other words entirely")]
    frame = spark.createDataFrame(rows, "video string, pair string, prediction string, reference string")
    each = {r.pair: r for r in captions.alignment_scores(frame, "pair").collect()}
    assert each["1"].rouge_l == 1 and each["1"].meteor > 0.99 and 0 < each["2"].meteor < 1 and each["3"].meteor == 0
    cider = {r.pair: r.cider for r in captions.cider_d(frame, "video", "pair").collect()}
    assert cider["1"] == pytest.approx(10) and 0 < cider["2"] < 10 and cider["3"] == 0
    got = {r.video: r for r in captions.caption_suite(frame, "video", "pair").collect()}
    assert 0 < got["v"].bleu_4 < 1 and got["w"].bleu_1 == 0


def test_cache_and_subset(spark, tmp_path):
    from scorelake.sources.loaders import in_subset

    bench, made = Benchmark(spark, Config(), str(tmp_path)), []
    for _ in range(2):
        assert bench.cached("m_d_1", lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1 and bench.clear_cache("m_*") == 1 and bench.clear_cache() == 0
    assert spark.read.json(bench.save_dated(spark.range(2), "results")).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"t": {"s": [1, 3]}}))
    rows = spark.createDataFrame([("t", "s", "1"), ("t", "s", "2"), ("u", "s", "3")], "task string, source string, id string")
    assert [r.id for r in in_subset(rows, spark, str(tmp_path / "s.json")).collect()] == ["1"]


def test_et_bench_captions(spark):
    schema = "task string, source string, video_path string, pos long, answer_text string, gt_segments array<array<struct<start:double,end:double>>>, events array<string>, reference_idx int"
    gold = [[(0.0, 10.0), (20.0, 30.0)]]
    words = ["a dog runs", "the cat sleeps"]
    right = "0.0 - 10.0 seconds, a dog runs. 20.0 - 30.0 seconds, the cat sleeps."
    rows = [("dvc", "s", "v", 0, "no idea", gold, words, None), ("dvc", "s", "w", 1, "no idea", gold, words, None), ("dvc", "s", "w", 2, right, gold, words, None), ("slc", "s", "v", 3, "nothing", gold, words, None)]
    rows += [("tvg", "s", "v", 4, "0 - 10", [[(0.0, 10.0)]], None, None)]
    got = {(r.metric, r.task): r.value for r in evaluators.et_bench(spark.createDataFrame(rows, schema)).collect()}
    # one of three samples was read: precision and recall of 1 become 1/3
    assert got["captioning", "dvc"] == pytest.approx(1 / 3, abs=1e-5) and got["captioning", "slc"] == 0 and got["captioning_similarity", "slc"] == 0
    similarity = got["captioning_similarity", "dvc"]
    assert 0.5 < similarity <= 1
    assert got["OVERALL", None] == pytest.approx((got["captioning", "dvc"] + similarity + 1) / 5, abs=2e-5)


def test_false_captions_lower_the_scores(spark):
    schema = "video string, idx int, span struct<start:double,end:double>, sentence string"
    gold = spark.createDataFrame([("v", 0, (0.0, 10.0), "a dog runs over the road")], schema)
    pred = spark.createDataFrame([("v", 0, (0.0, 6.0), "a dog runs over the road"), ("v", 1, (50.0, 60.0), "a cat sleeps on the mat")], schema)
    got = {r.tau: r for r in dense.caption_scores(pred, gold).collect()}
    # 0.6 of the interval is met: at 0.3 and 0.5 one caption of two is right, above none
    assert sorted(got) == [0.3, 0.5, 0.7, 0.9] and {r.videos for r in got.values()} == {1}
    assert [got[t].sim for t in sorted(got)] == pytest.approx([0.5, 0.5, 0, 0]) and [got[t].bleu_1 for t in sorted(got)] == pytest.approx([0.5, 0.5, 0, 0])


def test_retries_by_status():
    import io
    from email.message import Message
    from urllib.error import HTTPError, URLError

    error = lambda code: HTTPError("http://x", code, "no", Message(), io.BytesIO(b"content_filter"))
    assert [adapters.is_transient(e) for e in (error(429), error(502), error(400), URLError(TimeoutError()), URLError("refused"), ConnectionResetError(), ValueError("429"), adapters.ReplyError(503, ""), adapters.ReplyError(400, ""))] == [True, True, False, True, True, True, False, True, False]
    refuse = lambda *a: (_ for _ in ()).throw(adapters.ReplyError(400, '{"code": "content_filter"}'))
    assert adapters.Http("m", post=refuse).ask("x").startswith("[Content filtered")
    assert adapters.contents("p", [b"ab", "http://f"])[1:] == [{"type": "media", "uri": "data:image/jpeg;base64,YWI="}, {"type": "media", "uri": "http://f"}]


def test_batched_model(spark):
    def make():
        def model(prompts, media):
            if "bad" in prompts or len(prompts) > 3:
                raise RuntimeError("no")
            return [f"{len(prompts)}:{p}" for p in prompts]

        return model

    frame = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["bad", "e"]), (3, None)], "id long, prompt array<string>").coalesce(1)
    got = {r.id: r.reply for r in adapters.Batched(make, 3).answer(frame).collect()}
    assert got == {1: ["3:a", "3:b", "3:c", "1:d"], 2: ["[Error: no]", "1:e"], 3: []}


def test_chat_message(spark):
    frame = spark.createDataFrame([("p", None, "v.mp4", 2.0), ("q", "i.jpg", None, None)], "prompt string, image string, video string, fps double")
    told = [r.m for r in frame.select(adapters.chat_message(F.col("prompt"), F.col("image"), F.col("video"), F.col("fps")).alias("m")).collect()]
    assert [[(c.type, c.text, c.uri, c.fps) for c in m.content] for m in told] == [[("video", None, "v.mp4", 2.0), ("text", "p", None, None)], [("image", None, "i.jpg", None), ("text", "q", None, None)]]


def test_judged_evaluators(spark, tmp_path):
    def judge(rows):
        p = F.col("prompt")
        found = F.when(p.contains("List the events"), '{"events": ["one", "two"]}').when(p.contains("entails it"), '{"events": [{"event": "one", "relationship": "entailment"}, {"event": "two", "relationship": "contradiction"}]}')
        found = found.when(p.contains("Decide which is better"), '{"winner": "A"}').when(p.contains("Compare them by"), '{"winner": "Tie", "confidence": 0.4}').when(p.contains("one number from 0 to 1"), "about 1.7").when(p.contains("mention the following"), "yes")
        return found.when(p.contains("Turn this line"), "Is it so?").when(p.contains("Name the background"), "1 | cat").otherwise("Yes")

    adapters.register_model("ruled", lambda c: adapters.Rule(judge))
    rows = [{"id": i, "prediction": ["yes", "a cat"], "reference": ["Yes.", "a dog"], "prompt": "what", "source": "s", "task": "t"} for i in range(1, 4)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "b.json").write_text(json.dumps(rows[:2]))
    names = ["autodq", "autodq-direct", "etva", "test-50-ranking", "test50-dense-ranking", "pairwise", "event-hallusion-judged"]
    judged = {n: {"type": n, "judge": "ruled", "predictions_b": str(tmp_path / "b.json")} for n in names}
    config = Config().merged({"models": {"ruled": {"type": "ruled"}, "m": {"type": "http"}, "missing": {"type": "nowhere"}}, "datasets": {"stored": {"type": "generic", "load_predictions_from_file": str(tmp_path / "p.jsonl")}, "none": {"type": "capability", "data_path": str(tmp_path / "none")}}, "evaluators": judged})
    bench = Benchmark(spark, config, str(tmp_path / "out"))
    got = {(r.dataset, r.evaluator, r.task, r.metric): (r.value, r.error) for r in bench.run(["m"], ["stored", "none"], names).collect()}
    value = lambda *key: got["stored", *key][0]
    assert value("autodq", None, "recall") == 0.5 and value("autodq", "source", "success") == 3 and value("autodq-direct", None, "score") == 1.0
    assert value("etva", None, "clarity") == 1.0 and value("test-50-ranking", None, "win_rate_a") == 1.0 and value("test50-dense-ranking", "s", "total") == 2
    assert value("pairwise", None, "ties") == 2 and value("pairwise", None, "mean_confidence") == 0.4 and value("event-hallusion-judged", None, "description_acc") == 1.0
    assert all(got["none", n, None, "score"][1] for n in names)  # a dataset that isn't there fails alone
    row = bench.summary().first().asDict()
    assert row["stored_autodq"] == "0.5000" and row["stored_pairwise"] == "0.0000" and row["stored_test-50-ranking"] == "1.0000"
    assert spark.read.json(bench.save_summary()).count() == 1


def test_main_metrics(spark, tmp_path):
    samples = [{"id": i, "prediction": ["no", "no"], "reference": ["yes", "no"], "task": "t", "source": "s"} for i in range(3)]
    (tmp_path / "p.json").write_text(json.dumps(samples))
    config = Config().merged({"datasets": {"stored": {"type": "generic", "load_predictions_from_file": str(tmp_path / "p.json")}}})
    bench = Benchmark(spark, config, str(tmp_path / "out"))
    found = {(r.evaluator, r.metric): r.value for r in bench.run(["http"], ["stored"], ["video-hallucer", "rouge"]).collect() if r.task is None}
    row = bench.summary().first().asDict()
    assert row["stored_video-hallucer"] == f"{found['video-hallucer', 'both']:.4f}" and row["stored_rouge"] == f"{found['rouge', 'rougel']:.4f}"


def test_predictions_in_parquet(spark, tmp_path):
    rows = [("a", ["x", "y"], "r", 3)]
    spark.createDataFrame(rows, "id string, prediction array<string>, reference string, p int").write.parquet(str(tmp_path / "t.parquet"))
    (row,) = loaders.predictions(spark, str(tmp_path / "t.parquet")).collect()
    assert (row.id, row.prediction, row.reference_text, row.reference_idx, row.task) == ("a", ["x", "y"], ["r"], 3, None)


def test_choices_by_similarity(spark):
    segment = [[(0.0, 10.0)]]
    rows = [
        ("gvq", "s", "I think it is (B) 0 - 10", segment, 1, ["red car", "blue sky", "tree", "dog"]), ("gvq", "s2", "(C) 0 - 10", segment, 2, ["red car", "blue sky", "tree", "dog"]), ("gvq", "s3", "the blue sky 0 - 10", segment, 1, ["red car", "blue sky", "tree", "dog"]), ("gvq", "s4", "a. 0 - 10", segment, 1, ["a", "b", "c", "d"]),
        ("rar", "s", "it is the blue sky", None, 1, ["red car", "blue sky"]), ("rar", "s2", "(A) but rather blue sky", None, 1, ["red car", "blue sky"]), ("rar", "s3", "12.0 - 20.0", None, 1, ["[1.0, 2.0]", "[12.0, 20.0]"]), ("rar", "s4", "", None, 1, ["x", "y"]),
    ]
    frame = spark.createDataFrame(rows, "task string, source string, answer_text string, gt_segments array<array<struct<start:double,end:double>>>, reference_idx int, options array<string>")
    got = {(r.task, r.source): r.value for r in evaluators.et_bench(frame).collect() if r.task}
    assert (got["gvq", "s2"], got["gvq", "s3"], got["gvq", "s4"]) == (1.0, 1.0, 0.0)
    assert (got["rar", "s"], got["rar", "s2"], got["rar", "s3"], got["rar", "s4"]) == (1.0, 1.0, 1.0, 0.0)
    replies = frame.filter("task = 'rar' and source = 's'").select("task", "source", F.lit(None).cast("string").alias("answer_text"), F.array(F.lit("(B)")).alias("prediction"), "gt_segments", "reference_idx", "options")
    assert {(r.task, r.source): r.value for r in evaluators.et_bench(replies).collect() if r.task} == {("rar", "s"): 1.0}


def test_encoder(spark, monkeypatch):
    import numpy as np

    from scorelake.functions.encoders import encoder_similarity
    from scorelake.functions.parse import likest

    def make():
        return lambda texts: np.array([[t.count(c) for c in "abcdxyz"] for t in texts], float)

    similarity = encoder_similarity(make)
    rows = [("aab", "ab", ["xyz", "ab d"]), ("", "a", ["x"]), (None, "a", []), ("xyz", None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, options array<string>")
    got = [(r.sim, r.letter) for r in frame.select(similarity(F.col("a"), F.col("b")).alias("sim"), likest(F.col("a"), F.col("options"), similarity).alias("letter")).collect()]
    assert got[0] == (pytest.approx(3 / math.sqrt(10)), "b") and got[1] == (0.0, "a") and got[2] == (None, None) and got[3] == (None, None)
    monkeypatch.setattr(evaluators, "SIMILARITY", [similarity])
    sample = [("rar", "s", "aab", None, 1, ["xyz", "ab d"]), ("dvc", "s", "0 - 10 seconds, aab ab", [[(0.0, 10.0)]], None, None)]
    held = spark.createDataFrame(sample, "task string, source string, answer_text string, gt_segments array<array<struct<start:double,end:double>>>, reference_idx int, options array<string>").withColumn("events", F.array(F.lit("aab ab"))).withColumn("id", F.col("task"))
    got = {(r.metric, r.task): r.value for r in evaluators.et_bench(held).collect()}
    assert got["referring", "rar"] == 1.0 and got["captioning_similarity", "dvc"] > 0
