"""Recall and precision of described events, from judged relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.temporal import f1, ratio

OVERALL = "OVERALL"


def sample_scores(relations: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, source, recall, precision, f1) of relations (sample_id, source, side, relationship), one row for each event.

    Recall is the share of gold events (side recall) that the prediction entails, precision the share of predicted events (side precision) that
    the reference entails or leaves open. A side without events counts as 1. samples (sample_id, source) adds those without any event.
    """
    side, relation = F.col("side"), F.col("relationship")
    counts = relations.groupBy("sample_id", "source").agg(
        F.count_if(side == "recall").alias("n_gold"), F.count_if((side == "recall") & (relation == "entailment")).alias("hit_gold"),
        F.count_if(side == "precision").alias("n_pred"), F.count_if((side == "precision") & relation.isin("entailment", "neutral")).alias("hit_pred"),
    )
    if samples is not None:
        counts = samples.join(counts.drop("source"), "sample_id", "left").fillna(0)
    r = F.when(F.col("n_gold") == 0, 1.0).otherwise(ratio(F.col("hit_gold"), F.col("n_gold")))
    p = F.when(F.col("n_pred") == 0, 1.0).otherwise(ratio(F.col("hit_pred"), F.col("n_pred")))
    return counts.select("sample_id", "source", r.alias("recall"), p.alias("precision"), f1(r, p).alias("f1"))


def overall(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.round(F.avg("f1"), 5).alias("f1"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("precision"), 5).alias("precision"), F.coalesce(F.round(F.stddev_samp("f1"), 5), F.lit(0.0)).alias("std"))


def by_source(scores: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """By source with an OVERALL row: mean recall and precision, and the F1 of these means. failures (source) counts samples that couldn't be scored, of sources that have a row."""
    rows = scores.withColumn("source", F.coalesce("source", F.lit("UNKNOWN")))
    rolled = rows.rollup("source").agg(F.grouping("source").alias("whole"), F.count("*").alias("success"), F.avg("recall").alias("r"), F.avg("precision").alias("p"))
    named = rolled.select(F.when(F.col("whole") == 1, OVERALL).otherwise(F.col("source")).alias("source"), "success", F.round("r", 5).alias("recall"), F.round("p", 5).alias("precision"), F.round(f1(F.col("r"), F.col("p")), 5).alias("f1"))
    if failures is None:
        return named
    lost = failures.withColumn("source", F.coalesce("source", F.lit("UNKNOWN"))).rollup("source").agg(F.grouping("source").alias("whole"), F.count("*").alias("failed"))
    lost = lost.select(F.when(F.col("whole") == 1, OVERALL).otherwise(F.col("source")).alias("source"), "failed")
    return named.join(lost, "source", "left").withColumn("failed", F.coalesce("failed", F.lit(0)).cast("long"))


def missing_required(rows: DataFrame, *columns: str, by: str = "source") -> DataFrame:
    """By source: rows in which a required text is null or blank."""
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.coalesce(F.trim(c) == "", F.lit(True))
    return rows.filter(lacks).groupBy(F.coalesce(by, F.lit("UNKNOWN")).alias(by)).agg(F.count("*").alias("failed"))
