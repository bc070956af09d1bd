"""Temporal grounding scores over rows (task, source, pred, gold): pred and gold are arrays of intervals, pred is null where an answer can't be read.

All scores of a (task, source) come from one aggregation over per-sample expressions: one shuffle, of partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.temporal import best_iou, f1, iou, ratio, slots

# The thresholds of overlap.
THRESHOLDS = [0.1, 0.3, 0.5, 0.7]
CAPTION_THRESHOLDS = [0.3, 0.5, 0.7, 0.9]
KEYS = ("task", "source")


def _name(t: float) -> str:
    return str(int(round(t * 100)))


def _over(value: Column, prefix: str) -> list[Column]:
    return [F.round(F.avg((value >= t).cast("int")), 5).alias(f"{prefix}_{_name(t)}") for t in THRESHOLDS]


def first_span(rows: DataFrame) -> DataFrame:
    """First predicted interval against the first gold one: mean IoU and shares over each threshold (an unread answer counts as 0), and their mean."""
    own = F.coalesce(iou(F.get("pred", 0), F.get("gold", 0)), F.lit(0.0))
    scored = rows.select(*KEYS, F.col("pred").isNull().alias("failed"), own.alias("iou"))
    out = scored.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"), F.round(F.avg("iou"), 5).alias("miou"), *_over(F.col("iou"), "f1"))
    return out.withColumn("f1", F.round(sum((F.col(f"f1_{_name(t)}") for t in THRESHOLDS), F.lit(0.0)) / len(THRESHOLDS), 5))


def moment(rows: DataFrame, number: str = "number") -> DataFrame:
    """Share of answers whose number lies in any gold interval, ends included."""
    hit = F.coalesce(F.exists("gold", lambda g: (F.col(number) >= g["start"]) & (F.col(number) <= g["end"])), F.lit(False))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count_if(F.col(number).isNull()).alias("failed"), F.round(F.avg(hit.cast("int")), 5).alias("f1"))


def event_match(rows: DataFrame) -> DataFrame:
    """First predicted interval against the best gold one."""
    own = F.when(F.col("pred").isNull(), 0.0).otherwise(best_iou(F.get("pred", 0), F.col("gold")))
    scored = rows.select(*KEYS, F.col("pred").isNull().alias("failed"), own.alias("iou"))
    out = scored.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"), F.round(F.avg("iou"), 5).alias("miou"), *_over(F.col("iou"), "r"))
    return out.withColumn("mrec", F.round(sum((F.col(f"r_{_name(t)}") for t in THRESHOLDS), F.lit(0.0)) / len(THRESHOLDS), 5))


def localisation(rows: DataFrame) -> DataFrame:
    """All predicted intervals against all gold ones: by threshold, the harmonic mean of the shares of each side that the other meets; over all samples."""
    gold_best = F.transform("gold", lambda g: best_iou(g, F.col("pred")))
    pred_best = F.transform("pred", lambda p: best_iou(p, F.col("gold")))
    scored = rows.select(*KEYS, F.col("pred").isNull().alias("failed"), gold_best.alias("g"), pred_best.alias("p"))
    share = lambda a, t: ratio(F.size(F.filter(a, lambda x: x >= t)), F.size(a))
    own = {t: F.when(F.col("failed"), 0.0).otherwise(f1(share("g", t), share("p", t))) for t in THRESHOLDS}
    out = scored.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"), *[F.round(F.avg(c), 5).alias(f"f1_{_name(t)}") for t, c in own.items()])
    return out.withColumn("f1", F.round(sum((F.col(f"f1_{_name(t)}") for t in THRESHOLDS), F.lit(0.0)) / len(THRESHOLDS), 5))


def summary(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """Overlap of the one-second slots of predicted and gold intervals; a mean over the answers that could be read."""
    p, g = slots(F.col("pred"), limit), slots(F.col("gold"), limit)
    scored = rows.select(*KEYS, F.col("pred").isNull().alias("failed"), p.alias("p"), g.alias("g"))
    both = F.size(F.array_intersect("p", "g"))
    own = F.when(~F.col("failed"), f1(ratio(both, F.size("g")), ratio(both, F.size("p"))))
    return scored.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"), F.coalesce(F.round(F.avg(own), 5), F.lit(0.0)).alias("f1"))


def grounded_choice(rows: DataFrame) -> DataFrame:
    """Accuracy of outcome (hit, failed), and IoU of right answers' intervals alone, over all samples; failed are unread choices and unread intervals of right ones."""
    hit = F.col("outcome.hit")
    own = F.when(hit & F.col("pred").isNotNull(), iou(F.get("pred", 0), F.get("gold", 0))).otherwise(0.0)
    scored = rows.select(*KEYS, hit.alias("hit"), (F.col("outcome.failed") | (hit & F.col("pred").isNull())).alias("failed"), own.alias("iou"))
    out = scored.groupBy(*KEYS).agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"), F.round(F.avg(F.col("hit").cast("int")), 5).alias("acc"), F.round(F.avg("iou"), 5).alias("miou"), *_over(F.col("iou"), "r"))
    return out.withColumn("mrec", F.round(sum((F.col(f"r_{_name(t)}") for t in THRESHOLDS), F.lit(0.0)) / len(THRESHOLDS), 5))


def overall(rows: DataFrame) -> DataFrame:
    """Of rows (metric, task, source, value): each task's mean over sources, each metric's over tasks, and the unweighted mean over all (task, metric) rows. Nulls count as 0."""
    by_task = rows.groupBy("metric", "task").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("value"))
    rolled = by_task.rollup("metric").agg(F.grouping("metric").alias("whole"), F.count("*").alias("tasks"), F.round(F.avg("value"), 5).alias("value"))
    return rolled.select(F.when(F.col("whole") == 1, "OVERALL").otherwise(F.col("metric")).alias("metric"), "tasks", "value")
