"""Scores that need a model's judgement, as chains of requests to adapters: event description, ranking of pairs, scene questions.

Each step is a table with a column of replies, so it can be stored and replayed; what can't be read becomes a failure row or a default, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.adapters import events_prompt, pairwise_prompt, ranking_prompt, relations_prompt, score_prompt
from scorelake.functions import jsons, parse, text
from scorelake.operators import answers, events, judging


def _asked(adapter, rows: DataFrame, prompt: Column, out: str, media: str | None = None, accept: Callable[[str], bool] | None = None) -> DataFrame:
    had = "prompt" in rows.columns
    held = rows.withColumnRenamed("prompt", "own_prompt") if had else rows
    told = adapter.answer(held.withColumn("prompt", prompt), out, **({"media": media} if media else {}), **({"accept": accept} if accept else {})).drop("prompt")
    return told.withColumnRenamed("own_prompt", "prompt") if had else told


def event_relations(samples: DataFrame, judge) -> tuple[DataFrame, DataFrame]:
    """((sample_id, source, side, relationship), failures (sample_id, source)) of samples (id, source, prediction text, reference text, events of the reference or null).

    Gold events are judged against the prediction, predicted ones against the reference. A reply that can't be read leaves all events open; further
    relations than events are cut off, missing ones don't count as met.
    """
    blank = F.coalesce(F.trim("prediction") == "", F.lit(True)) | F.coalesce(F.trim("reference") == "", F.lit(True))
    rows = samples.select(F.col("id").alias("sample_id"), "source", "prediction", "reference", "events")
    failures = rows.filter(blank).select("sample_id", "source")
    rows = rows.filter(~blank)
    rows = _asked(judge, rows, events_prompt(F.col("prediction")), "told_pred").withColumn("pred_events", F.coalesce(jsons.events(F.col("told_pred")), F.array().cast("array<string>")))
    rows = _asked(judge, rows, events_prompt(F.col("reference")), "told_ref").withColumn("gold_events", F.coalesce("events", jsons.events(F.col("told_ref")), F.array().cast("array<string>")))
    both = rows.select("sample_id", "source", F.explode(F.array(F.struct(F.lit("recall").alias("side"), F.col("gold_events").alias("e"), F.col("prediction").alias("t")), F.struct(F.lit("precision").alias("side"), F.col("pred_events").alias("e"), F.col("reference").alias("t")))).alias("x"))
    both = both.select("sample_id", "source", "x.side", "x.e", "x.t")
    both = _asked(judge, both, relations_prompt(F.col("e"), F.col("t")), "told")
    read = jsons.relations(F.col("told"))
    label = F.transform("e", lambda _, i: F.when(read.isNull(), "neutral").otherwise(F.coalesce(F.lower(F.get(read, i)["relationship"]), F.lit("contradiction"))))
    return both.select("sample_id", "source", "side", F.explode(label).alias("relationship")), failures


def autodq(samples: DataFrame, judge) -> DataFrame:
    """Recall, precision and F1 by source with an OVERALL row, and the number of samples without a text to judge."""
    relations, failures = event_relations(samples, judge)
    every = samples.join(failures.select(F.col("sample_id").alias("id")), "id", "left_anti").select(F.col("id").alias("sample_id"), "source")
    return events.by_source(events.sample_scores(relations, every), failures)


def ranked(a: DataFrame, b: DataFrame, judge, task: str = "video description", frames: DataFrame | None = None) -> DataFrame:
    """(id, category, winner, confidence, reason, scores, success) for the ids that both predictions (id, pos, source, text) have; withheld responses are skipped.

    frames (id, frames: addresses or bytes of pictures) go along with the request where there are any. A verdict that can't be read is asked for once more.
    """
    pairs = judging.common(judging.latest(a, "id", ["pos"]), judging.latest(b, "id", ["pos"]))
    pairs = judging.screened(pairs.select("id", F.coalesce("a.source", F.lit("unknown")).alias("category"), F.col("a.text").alias("response_a"), F.col("b.text").alias("response_b")))
    fair = pairs.filter(~F.col("skipped"))
    if frames is not None:
        fair = fair.join(frames.groupBy("id").agg(F.first("frames").alias("frames")), "id", "left")
    told = _asked(judge, fair, ranking_prompt(F.col("response_a"), F.col("response_b"), task), "told", "frames" if frames is not None else None, jsons.readable_verdict).withColumn("v", jsons.verdict(F.col("told")))
    fields = [F.col(f"v.{c}").alias(c) for c in ("winner", "confidence", "reason", "scores")]
    done = told.select("id", "category", *fields, (F.col("v.status") == "ok").alias("success"))
    kinds = {f.name: f.dataType for f in done.schema.fields}
    skipped = pairs.filter("skipped").select("id", "category", F.lit("skipped").alias("winner"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("confidence", "reason", "scores")], F.lit(False).alias("success"))
    return done.union(skipped)


def compared(a: DataFrame, b: DataFrame, judge, criteria: list[str], template: str | None = None) -> DataFrame:
    """(id, category, winner, confidence, reasoning, status) by a generic judge, for the ids that both predictions (id, pos, source, question, text) have."""
    pairs = judging.common(judging.latest(a, "id", ["pos"]), judging.latest(b, "id", ["pos"]))
    pairs = pairs.select("id", F.coalesce("a.source", F.lit("unknown")).alias("category"), F.col("a.question").alias("question"), F.col("a.text").alias("response_a"), F.col("b.text").alias("response_b"))
    told = _asked(judge, pairs, pairwise_prompt(F.col("response_a"), F.col("response_b"), F.col("question"), criteria, template), "told")
    return told.select("id", "category", jsons.pairwise(F.col("told")).alias("v")).select("id", "category", "v.*")


def direct_score(samples: DataFrame, judge) -> DataFrame:
    """(id, score): the first number of a judge's reply, held between 0 and 1; 0 where there is none. samples: id, prediction, reference."""
    told = _asked(judge, samples.select("id", "prediction", "reference"), score_prompt(F.col("prediction"), F.col("reference")), "told")
    return told.select("id", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), parse.first_number(F.col("told")))), F.lit(0.0)).alias("score"))


def scene_graph(samples: DataFrame, writer) -> DataFrame:
    """samples (id, description) with graph: lines `entity`, then attributes `entity | attribute | value`, then relations `id | entity | relation | entity`, asked for in this order."""
    ask = lambda what: F.concat(F.lit(what), F.col("description"))
    rows = _asked(writer, samples, ask("Name the background, the camera and each entity of this description, one to a line, as `id | entity`.\n\n"), "entities")
    rows = _asked(writer, rows, F.concat(F.lit("Give the attributes of these entities, one to a line, as `entity | attribute | value`; say `no mention` for those without any.\n\n"), F.col("entities"), F.lit("\n\nAll entities: "), answers.entity_names(F.col("entities")), F.lit("\n\n"), F.col("description")), "attributes")
    rows = _asked(writer, rows, F.concat(F.lit("Give the relations between these entities, one to a line, as `id | entity | relation | entity`.\n\n"), F.col("entities"), F.lit("\n\n"), F.col("description")), "relations")
    return rows.withColumn("graph", F.concat_ws("\n", "entities", "attributes", "relations")).drop("entities", "attributes", "relations")


def scene_questions(samples: DataFrame, writer) -> DataFrame:
    """(id, pos, question): a question for each line of a sample's graph, and its own questions (custom, if there is such a column) after them, without repeats."""
    lines = samples.select("id", F.posexplode(answers.scene_questions(F.col("graph"))).alias("pos", "line"))
    made = _asked(writer, lines, F.concat(F.lit("Turn this line of a scene graph into one yes/no question.\n\n"), F.col("line")), "question").select("id", "pos", "question")
    if "custom" in samples.columns:
        made = made.union(samples.select("id", F.posexplode("custom").alias("pos", "question")).select("id", F.col("pos") + 1_000_000, "question"))
    return made.filter(F.coalesce(F.trim("question"), F.lit("")) != "").groupBy("id", "question").agg(F.min("pos").alias("pos")).select("id", "pos", "question")


def scene_score(samples: DataFrame, writer, vlm) -> DataFrame:
    """By sample: yes, no and unclear answers to its scene questions, from a description to a graph to questions to a model's answers."""
    asked = scene_questions(scene_graph(samples, writer), writer)
    told = _asked(vlm, asked, F.concat("question", F.lit("\nAnswer with yes or no.")), "raw_answer")
    status = F.when(F.col("raw_answer").isNull() | F.col("raw_answer").startswith("[Error"), "error").otherwise("success")
    return answers.scene_answers(told.withColumn("status", status), "id")


def described(samples: DataFrame, judge) -> DataFrame:
    """(task, matched): whether a judge finds the last reference in the last prediction; a blank prediction isn't asked about and doesn't match."""
    last = samples.select("task", F.element_at("prediction", -1).alias("p"), F.element_at("reference_text", -1).alias("r"))
    blank = F.coalesce(F.trim("p") == "", F.lit(True))
    told = _asked(judge, last.filter(~blank), F.concat(F.lit("Does this description mention the following? Answer with yes or no.\n\nDescription: "), F.col("p"), F.lit("\n\nTo be mentioned: "), F.col("r")), "told")
    return told.select("task", F.coalesce(text.judge_prefix(F.col("told")) == "yes", F.lit(False)).alias("matched")).union(last.filter(blank).select("task", F.lit(False)))
