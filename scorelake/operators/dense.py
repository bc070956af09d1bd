"""Dense captions: predicted intervals of a video against its gold ones.

Intervals (video, idx, span) meet by video, level and node (operators.intervals), so a video of very many intervals is spread over nodes, and one as long as a model's text
may say costs a few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.temporal import f1, hull_iou, ratio
from scorelake.functions.text import plain_words
from scorelake.operators.captions import caption_suite
from scorelake.operators.grounding import CAPTION_THRESHOLDS
from scorelake.operators.intervals import meeting

#: The reference of captions that meet no gold interval: one word, of private use, that no caption has.
NOTHING = "\ue000"
SCORES = ["bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge_l", "meteor", "cider", "sim"]


def overlaps(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(video, pred_i, ref_i, iou) for pairs of one video that share more than a point."""
    side = lambda t: t.select("video", "idx", "span")
    return meeting(side(pred), side(gold), ["video"]).select("video", F.col("l.idx").alias("pred_i"), F.col("r.idx").alias("ref_i"), hull_iou(F.col("l.span"), F.col("r.span")).alias("iou"))


def detection(pred: DataFrame, gold: DataFrame, thresholds: list[float] = CAPTION_THRESHOLDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """(tau, videos, precision, recall, f1): per video, the shares of gold intervals met and of predicted ones that meet any with an IoU over tau; means over the videos that have gold ones.
    keys are columns of gold, each video's own, by which the means are taken."""
    taus = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("tau")
    videos = gold.groupBy(*keys, "video").agg(F.count("*").alias("n_gold")).join(pred.groupBy("video").agg(F.count("*").alias("n_pred")), "video", "left")
    met = overlaps(pred, gold).select("video", "pred_i", "ref_i", "iou", taus).filter("iou > tau")
    met = met.groupBy("video", "tau").agg(F.countDistinct("pred_i").alias("hit_pred"), F.countDistinct("ref_i").alias("hit_gold"))
    each = videos.select("*", taus).join(met, ["video", "tau"], "left")
    p, r = ratio(F.col("hit_pred"), F.col("n_pred")), ratio(F.col("hit_gold"), F.col("n_gold"))
    out = each.groupBy(*keys, "tau").agg(F.count("*").alias("videos"), F.avg(p).alias("p"), F.avg(r).alias("r"))
    return out.select(*keys, "tau", "videos", F.round("p", 5).alias("precision"), F.round("r", 5).alias("recall"), F.round(f1(F.col("r"), F.col("p")), 5).alias("f1"))


def scaled_f1(detected: DataFrame, scale: float | None = None, parsed: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """detection's rows with precision and recall scaled by the share of samples that could be read, and their F1."""
    if scale is None:
        rows = detected.join(F.broadcast(parsed.agg(F.countDistinct("video").alias("read"))).join(F.broadcast(samples.agg(F.countDistinct("video").alias("of")))))
        k = ratio(F.col("read"), F.col("of"))
    else:
        rows, k = detected, F.lit(scale)
    return rows.select("tau", F.round(F.col("precision") * k, 5).alias("precision"), F.round(F.col("recall") * k, 5).alias("recall"), F.round(f1(F.col("recall") * k, F.col("precision") * k), 5).alias("f1"))


def unmatched(pred: DataFrame, gold: DataFrame, tau: float) -> DataFrame:
    """Predicted intervals that meet no gold one with an IoU of tau or more; caption_scores scores their captions against NOTHING."""
    return pred.join(overlaps(pred, gold).filter(F.col("iou") >= tau).select("video", F.col("pred_i").alias("idx")).distinct(), ["video", "idx"], "left_anti").select("video", F.col("idx").alias("pred_i"))


def caption_scores(pred: DataFrame, gold: DataFrame, thresholds: list[float] = CAPTION_THRESHOLDS, keys: tuple[str, ...] = (), similarity: Callable[[Column, Column], Column] | None = None, split: Callable[[Column], Column] = plain_words, synonyms: DataFrame | None = None) -> DataFrame:
    """(keys, tau, videos, SCORES): caption_suite of each video's captions, predicted ones against each gold one that they meet with an IoU of tau or more, and against
    NOTHING if they meet none; means over the videos that have gold ones, 0 for one without predictions. keys as for detection. A null sentence counts as empty. split and synonyms as for caption_suite."""
    side = lambda t, i, name: t.select("video", F.col("idx").alias(i), F.coalesce("sentence", F.lit("")).alias(name))
    videos = gold.select(*keys, "video").distinct()
    taus = F.array(*[F.lit(float(t)) for t in thresholds])
    at = F.explode(taus).alias("tau")
    # a pair is a row once, with the thresholds at which it counts, until it is where its video's others are
    met = overlaps(pred, gold).filter(F.col("iou") >= min(thresholds)).select("video", "pred_i", "ref_i", "iou")
    pairs = met.join(side(gold, "ref_i", "reference"), ["video", "ref_i"]).select("video", "pred_i", "ref_i", "reference", F.filter(taus, lambda t: F.col("iou") >= t).alias("taus"))
    best = met.groupBy("video", "pred_i").agg(F.max("iou").alias("iou"))
    alone = pred.join(videos.select("video").distinct(), "video", "left_semi").select("video", F.col("idx").alias("pred_i")).join(best, ["video", "pred_i"], "left")
    alone = alone.select("video", "pred_i", F.lit(None), F.lit(NOTHING), F.filter(taus, lambda t: F.coalesce(F.col("iou") < t, F.lit(True))).alias("taus")).filter(F.size("taus") > 0)
    pairs = pairs.union(alone).join(side(pred, "pred_i", "prediction"), ["video", "pred_i"]).repartition(int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video")
    pairs = pairs.select("video", "pred_i", "ref_i", "prediction", "reference", F.explode("taus").alias("tau")).withColumn("of", F.concat_ws("\x1f", "tau", "video"))
    own = caption_suite(pairs.withColumn("pair", F.concat_ws("\x1f", "of", "pred_i", "ref_i")), "of", "pair", similarity, split, synonyms, placed=True)
    each = videos.select("*", at).withColumn("of", F.concat_ws("\x1f", "tau", "video")).join(own, "of", "left")
    return each.groupBy(*keys, "tau").agg(F.count("*").alias("videos"), *[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in SCORES])
