"""Evaluators by name: from samples with predictions to rows (task, source, metric, value).

Those of JUDGED also get a judge, an adapter, and the evaluator's settings; MAIN names the metric that stands for an evaluator in a summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import judged
from scorelake.functions import parse, text
from scorelake.functions.temporal import f1, ratio
from scorelake.operators import answers, captions, dense, events, grounding, judging
from scorelake.schema import canonical
from scorelake.sources import loaders

RESULT = "task string, source string, metric string, value double"
#: How alike two texts are, for choices and captions; encoders.encoder_similarity makes one from a sentence encoder.
SIMILARITY: list[Callable[[Column, Column], Column]] = [captions.hashed_similarity]


def _rows(frame: DataFrame, metrics: list[str], task: str | None = None, source: str | None = None) -> DataFrame:
    """Columns as rows of RESULT."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
    name = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    return frame.select(name(task).alias("task"), name(source).alias("source"), each).select("task", "source", "x.metric", "x.value")


def _text(c: str) -> Column:
    return F.get(c, 0)


def _truth(samples: DataFrame) -> DataFrame:
    """(id, source, prediction, reference): the first prediction, and the ground truth or else the first reference."""
    return samples.select("id", "source", _text("prediction").alias("prediction"), F.coalesce("ground_truth", _text("reference_text")).alias("reference"))


def _summary(scores: DataFrame, metric: str) -> DataFrame:
    return _rows(captions.score_summary(scores, metric).select(F.col("mean").alias(metric), F.col("std").alias(f"{metric}_std"), F.col("num_evaluated").alias(f"{metric}_n")), [metric, f"{metric}_std", f"{metric}_n"])


def bleu(samples: DataFrame) -> DataFrame:
    return _summary(captions.bleu(_truth(samples), "id"), "bleu")


def rouge(samples: DataFrame) -> DataFrame:
    scores = captions.stemmed_rouge(_truth(samples), "id")
    return _rows(scores.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("rouge1", "rouge2", "rougel")]), ["rouge1", "rouge2", "rougel"])


def cider(samples: DataFrame) -> DataFrame:
    return _summary(captions.cider_lite(_truth(samples), "id"), "cider")


def scene_graph(samples: DataFrame) -> DataFrame:
    return _summary(captions.scene_scores(_truth(samples), "id").withColumnRenamed("score", "scene"), "scene")


def hallucination(samples: DataFrame) -> DataFrame:
    by_task = answers.pair_accuracy(samples.select("task", F.col("reference_text").alias("reference"), "prediction"))
    overall = answers.macro(by_task, "basic", "halluc", "both").withColumn("fact", (F.col("basic") + F.col("halluc")) / 2)
    return _rows(by_task, ["basic", "halluc", "both"], "task").union(_rows(overall, ["basic", "halluc", "both", "fact"]))


def event_hallucination(samples: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Yes/no questions are all but the last; judged (task, reply) has a judge's replies to the last ones, the descriptions."""
    front = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    by_task = answers.prefix_accuracy(samples.filter(F.coalesce("task", F.lit("")) != "").select("task", F.transform(front("reference_text"), text.answer_prefix).alias("reference"), front("prediction").alias("prediction")))
    out = _rows(by_task, ["acc", "not_match"], "task").union(_rows(answers.micro(by_task), ["acc"]))
    if judged is not None:
        said = judged.withColumn("said", text.judge_prefix(F.col("reply")))
        told = said.groupBy("task").agg(F.count("*").alias("total"), F.count_if(F.col("said") == "yes").alias("correct"))
        out = out.union(_rows(answers.micro(told).withColumnRenamed("acc", "description_acc"), ["description_acc"]))
    return out


def perception(samples: DataFrame) -> DataFrame:
    asked = answers.zipped(samples, "reference_text", "prediction").select(F.col("reference_text").alias("reference"), "prediction")
    return _rows(answers.digit_accuracy(asked, ["0", "1", "2"]), ["total", "answered", "correct", "acc"])


def tomato(samples: DataFrame) -> DataFrame:
    rows = samples.filter(F.coalesce("task", F.lit("")) != "").select("task", "options", F.col("reference_idx").alias("answer"), _text("prediction").alias("prediction"))
    return _rows(answers.option_accuracy(rows), ["total", "answered", "correct", "acc"], "task")


def tvbench(samples: DataFrame) -> DataFrame:
    """Exact match with the candidate, an extension: the loader alone is given."""
    rows = samples.select("task", "options", (F.array_position("options", _text("reference_text")) - 1).cast("int").alias("answer"), _text("prediction").alias("prediction"))
    return _rows(answers.option_accuracy(rows), ["total", "answered", "correct", "acc"], "task")


def _captioning(samples: DataFrame) -> DataFrame:
    """(metric, task, source, value) of dense captions, F1 and similarity: means over CAPTION_THRESHOLDS of the F1 of intervals, scaled by the share of samples that could be read, and of the similarity.
    Of a video's readable samples the last counts."""
    keys = list(grounding.KEYS)
    whole = canonical(samples).select(*keys, F.concat_ws("\x1f", *keys, F.coalesce("video_path", "id", F.lit(""))).alias("video"), "id", "pos", F.flatten("gt_segments").alias("gold"), "events", parse.timed_captions(F.col("answer_text")).alias("pred"))
    total = whole.groupBy(*keys).agg(ratio(F.countDistinct(F.when(F.col("pred").isNotNull(), F.col("video"))), F.count("*")).alias("k"))
    last = whole.filter("pred is not null").groupBy(*keys, "video").agg(F.max_by(F.struct("pred", "gold", "events"), F.struct("pos", "id")).alias("s"))
    pred = last.select("video", F.posexplode("s.pred").alias("idx", "x")).select("video", "idx", "x.span", "x.sentence")
    gold = last.select(*keys, "video", "s.events", F.posexplode("s.gold").alias("idx", "span")).select(*keys, "video", "idx", "span", F.get("events", F.col("idx")).alias("sentence"))
    found = dense.detection(pred, gold, keys=grounding.KEYS).join(total, keys)
    met = found.groupBy(*keys).agg(F.round(F.avg(f1(F.col("recall") * F.col("k"), F.col("precision") * F.col("k"))), 5).alias("f1"))
    like = dense.caption_scores(pred, gold, keys=grounding.KEYS, similarity=SIMILARITY[0]).groupBy(*keys).agg(F.round(F.avg("sim"), 5).alias("sim"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), zero(c).alias("value")) for m, c in (("captioning", "f1"), ("captioning_similarity", "sim"))])).alias("x")
    return total.join(met, keys, "left").join(like, keys, "left").select(*keys, both).select("x.metric", *keys, "x.value")


def et_bench(samples: DataFrame) -> DataFrame:
    """Grounding tasks by their codes, choices by letter or else by similarity with the options, dense captions by intervals and similarity, and the overall mean.
    An answer is the stored one, or else the first prediction."""
    rows = samples.filter((F.coalesce("task", F.lit("")) != "") & (F.coalesce("source", F.lit("")) != ""))
    rows = canonical(rows).withColumn("answer_text", F.coalesce("answer_text", _text("prediction")))
    chosen = (F.col("answer_text"), F.get(F.array(*map(F.lit, parse.LETTERS)), F.col("reference_idx")), F.col("options"), SIMILARITY[0])
    read = rows.select("task", "source", parse.time_spans(F.col("answer_text")).alias("pred"), F.flatten("gt_segments").alias("gold"), parse.first_number(F.col("answer_text")).alias("number"), F.when(F.col("task") == "gvq", parse.leading_choice(*chosen)).otherwise(parse.choice(*chosen)).alias("outcome"))
    of = lambda *tasks: read.filter(F.col("task").isin(*tasks))
    plans = [
        ("referring", answers.choice_accuracy(of("rar", "eca", "rvq").withColumn("task", F.concat_ws("\x1f", "task", "source")), "task").select(F.split("task", "\x1f")[0].alias("task"), F.split("task", "\x1f")[1].alias("source"), "acc"), "acc"),
        ("grounding", grounding.first_span(of("tvg", "epm")), "f1"), ("grounding", grounding.localisation(of("tal")), "f1"), ("grounding", grounding.summary(of("evs")), "f1"), ("grounding", grounding.moment(of("vhd")), "f1"),
        ("complex", grounding.event_match(of("tem")), "mrec"), ("complex", grounding.grounded_choice(of("gvq")), "mrec"),
    ]
    parts = [frame.select(F.lit(metric).alias("metric"), "task", "source", F.col(c).alias("value")) for metric, frame, c in plans]
    every = parts[0]
    for p in [*parts[1:], _captioning(rows.filter(F.col("task").isin("dvc", "slc")))]:
        every = every.union(p)
    total = grounding.overall(every).select(F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("source"), "metric", "value")
    return every.select("task", "source", "metric", "value").union(total)


def _described(samples: DataFrame) -> DataFrame:
    """(id, source, prediction, reference, events) for a judge of descriptions."""
    return canonical(samples).select("id", "source", _text("prediction").alias("prediction"), F.coalesce(_text("reference_text"), "ground_truth").alias("reference"), "events")


def autodq(samples: DataFrame, judge, settings: dict) -> DataFrame:
    """Recall, precision and F1 of described events by source, and over all."""
    rows = judged.autodq(_described(samples), judge)
    whole = F.col("source") == events.OVERALL
    named = rows.select(F.when(~whole, "source").alias("task"), F.when(~whole, F.col("source")).alias("source"), *[c for c in rows.columns if c != "source"])
    return _rows(named, ["recall", "precision", "f1", "success", "failed"], "task", "source")


def direct(samples: DataFrame, judge, settings: dict) -> DataFrame:
    """A judge's number for each sample: mean, deviation and count."""
    return _summary(judged.direct_score(_described(samples), judge), "score")


def scene_questions(samples: DataFrame, judge, settings: dict) -> DataFrame:
    """Yes, no and unclear answers to questions made from each sample's description: its reference is described, and the model's words are what is asked."""
    described = canonical(samples).select("id", _text("prediction").alias("description")).filter(F.coalesce(F.trim("description"), F.lit("")) != "")
    own = judged.scene_score(described, judge, settings.get("vlm_adapter") or judge)
    total = answers.rates(own.agg(F.count("*").alias("samples"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "answered", "n_yes", "n_no", "n_unclear")]))
    return _rows(total, ["samples", "total", "answered", "n_yes", "n_no", "n_unclear", "yes_rate", "no_rate", "clarity"])


def _sides(samples: DataFrame, settings: dict) -> tuple[DataFrame, DataFrame]:
    """Both models' texts (id, pos, source, question, text): of predictions_a, or else the samples, and of predictions_b."""
    if not settings.get("predictions_b"):
        raise ValueError("a comparison needs predictions_b, the path of the other model's predictions")
    held = lambda key: loaders.predictions(samples.sparkSession, settings[key]) if settings.get(key) else samples
    told = lambda rows: canonical(rows).select("id", "pos", F.coalesce("source", "task").alias("source"), _text("prompt").alias("question"), _text("prediction").alias("text"))
    return told(held("predictions_a")), told(held("predictions_b"))


def ranking(task: str) -> Callable[[DataFrame, object, dict], DataFrame]:
    def evaluate(samples: DataFrame, judge, settings: dict) -> DataFrame:
        """Win rates over all pairs and by category. frames, a path of Parquet (id, frames), has pictures to show to the judge."""
        a, b = _sides(samples, settings)
        frames = samples.sparkSession.read.parquet(settings["frames"]) if settings.get("frames") else None
        verdicts = judged.ranked(a, b, judge, settings.get("task", task), frames)
        whole = judging.win_rates(verdicts)
        by = judging.win_rates_by_category(verdicts).filter(F.col("category") != judging.OVERALL)
        return _rows(whole, ["total", "valid", "errors", "a_wins", "b_wins", "ties", "win_rate_a", "win_rate_b", "tie_rate"]).union(_rows(by, ["total", "a_wins", "b_wins", "ties", "a_rate", "b_rate", "tie_rate"], "category"))

    return evaluate


def pairwise(samples: DataFrame, judge, settings: dict) -> DataFrame:
    """Counts, rates and mean confidence of a generic judge's comparisons by criteria."""
    a, b = _sides(samples, settings)
    verdicts = judged.compared(a, b, judge, settings.get("criteria") or CRITERIA, settings.get("template"))
    return _rows(judging.pairwise_stats(verdicts), ["total", "a_wins", "b_wins", "ties", "a_rate", "b_rate", "tie_rate", "mean_confidence"])


def judged_event_hallucination(samples: DataFrame, judge, settings: dict) -> DataFrame:
    """event_hallucination with the last questions, the descriptions, judged."""
    told = judged.described(canonical(samples), judge)
    return event_hallucination(samples, told.select("task", F.when(F.col("matched"), "yes").otherwise("no").alias("reply")))


CRITERIA = ["accuracy", "completeness", "clarity"]
EVALUATORS: dict[str, Callable[..., DataFrame]] = {
    "bleu": bleu, "rouge": rouge, "cider": cider, "dsg": scene_graph, "davidsonian-sg": scene_graph, "davidsonian-scene-graph": scene_graph, "video-hallucer": hallucination, "event-hallusion": event_hallucination, "perception-test": perception, "tomato": tomato, "tvbench": tvbench, "etbench": et_bench,
}
JUDGED: dict[str, Callable[[DataFrame, object, dict], DataFrame]] = {
    "autodq": autodq, "autodq-direct": direct, "etva": scene_questions, "test-50-ranking": ranking("camera movement"), "test50-ranking": ranking("camera movement"), "test-50-dense-ranking": ranking("dense video description"), "test50-dense-ranking": ranking("dense video description"),
    "pairwise-ranking": pairwise, "pairwise": pairwise, "event-hallusion-judged": judged_event_hallucination,
}
MAIN = {
    "bleu": "bleu", "rouge": "rougel", "cider": "cider", "dsg": "scene", "davidsonian-sg": "scene", "davidsonian-scene-graph": "scene", "video-hallucer": "both", "event-hallusion": "acc", "event-hallusion-judged": "acc", "perception-test": "acc", "tomato": "acc", "tvbench": "acc", "etbench": "OVERALL",
    "autodq": "f1", "autodq-direct": "score", "etva": "clarity", "test-50-ranking": "win_rate_a", "test50-ranking": "win_rate_a", "test-50-dense-ranking": "win_rate_a", "test50-dense-ranking": "win_rate_a", "pairwise-ranking": "a_rate", "pairwise": "a_rate",
}


def _key(name: str) -> str:
    return name.lower().replace("_", "-")


def register(name: str, evaluate: Callable[[DataFrame], DataFrame], main: str | None = None) -> None:
    EVALUATORS[_key(name)] = evaluate
    if main:
        MAIN[_key(name)] = main


def evaluator_for(name: str, type: str | None = None) -> Callable[..., DataFrame]:
    for key in (type, name):
        if key and (found := EVALUATORS.get(_key(key))):
            return found
    raise KeyError(f"no evaluator {name!r}; known: {', '.join(sorted(EVALUATORS | JUDGED))}")


def judged_evaluator(name: str, type: str | None = None) -> Callable[[DataFrame, object, dict], DataFrame] | None:
    """The evaluator that needs a judge, if the type, or else the name, is one's."""
    return next((JUDGED[_key(key)] for key in (type, name) if key and _key(key) in JUDGED), None)


def main_metric(name: str, type: str | None = None) -> str | None:
    return next((MAIN[_key(key)] for key in (type, name) if key and _key(key) in MAIN), None)
