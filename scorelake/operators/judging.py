"""Head-to-head comparison of two models' outputs: pairing, verdicts, win rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.temporal import ratio
from scorelake.functions.text import is_filtered

OVERALL = "OVERALL"


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key that isn't null, empty or 0: the last by order. The maximum is kept as rows are read, so no key is gathered or sorted."""
    kept = rows.filter(F.col(key).isNotNull() & ~F.col(key).cast("string").isin("", "0"))
    others = [c for c in rows.columns if c != key]
    best = kept.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row"))
    return best.select(key, "row.*")


def common(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both sides with equal keys, as structs a and b."""
    left, right = (d.select(key, F.struct(*[c for c in d.columns if c != key]).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return left.join(right, key)


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default: str = "unknown") -> DataFrame:
    return rows.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def screened(pairs: DataFrame, a: str = "response_a", b: str = "response_b") -> DataFrame:
    """pairs with skipped: whether a content filter has withheld either response."""
    return pairs.withColumn("skipped", is_filtered(F.col(a)) | is_filtered(F.col(b)))


def _outcomes(winner: Column, success: Column) -> dict[str, Column]:
    won = lambda w: F.count_if(success & (winner == w))
    return {"a_wins": won("A"), "b_wins": won("B"), "ties": won("tie")}


def win_rates(judgments: DataFrame) -> DataFrame:
    """One row over judgments (winner, success): counts, and rates over the valid ones; skipped and failed ones are errors."""
    counts = judgments.agg(F.count("*").alias("total"), *[c.alias(n) for n, c in _outcomes(F.col("winner"), F.col("success")).items()])
    valid = F.col("a_wins") + F.col("b_wins") + F.col("ties")
    return counts.withColumns({"valid": valid, "errors": F.col("total") - valid, "win_rate_a": F.round(ratio(F.col("a_wins"), valid), 5), "win_rate_b": F.round(ratio(F.col("b_wins"), valid), 5), "tie_rate": F.round(ratio(F.col("ties"), valid), 5)})


def win_rates_by_category(judgments: DataFrame, category: str = "category") -> DataFrame:
    """A row for each category of the successful judgments, and an OVERALL row, by one rollup."""
    rows = judgments.filter("success").withColumn(category, F.coalesce(category, F.lit("UNKNOWN")))
    rolled = rows.rollup(category).agg(F.grouping(category).alias("whole"), F.count("*").alias("total"), *[c.alias(n) for n, c in _outcomes(F.col("winner"), F.lit(True)).items()])
    named = rolled.withColumn(category, F.when(F.col("whole") == 1, OVERALL).otherwise(F.col(category))).drop("whole")
    return named.withColumns({f"{n}_rate": F.round(ratio(F.col(c), F.col("total")), 5) for n, c in (("a", "a_wins"), ("b", "b_wins"), ("tie", "ties"))})


def pairwise_stats(verdicts: DataFrame, category: str | None = None) -> DataFrame:
    """Counts, rates over all verdicts (winner Model A, Model B or Tie; unread ones are ties of confidence 0) and mean confidence, overall or by category."""
    grouped = verdicts.groupBy(category) if category else verdicts.groupBy()
    won = lambda w: F.count_if(F.col("winner") == w)
    counts = grouped.agg(F.count("*").alias("total"), won("Model A").alias("a_wins"), won("Model B").alias("b_wins"), won("Tie").alias("ties"), F.round(F.avg("confidence"), 5).alias("mean_confidence"))
    return counts.withColumns({f"{n}_rate": F.round(ratio(F.col(c), F.col("total")), 5) for n, c in (("a", "a_wins"), ("b", "b_wins"), ("tie", "ties"))})


def criteria_gap(verdicts: DataFrame) -> DataFrame:
    """Mean scores of both responses by criterion, from verdicts' scores (map of response_a and response_b to criterion scores)."""
    rows = verdicts.select(F.explode(F.map_keys(F.col("scores")["response_a"])).alias("criterion"), "scores")
    return rows.groupBy("criterion").agg(F.avg(F.col("scores")["response_a"][F.col("criterion")]).alias("a"), F.avg(F.col("scores")["response_b"][F.col("criterion")]).alias("b"))


def throughput(elapsed: float, items: int, sequential_each: float = 5.0) -> dict[str, float]:
    """Seconds per item, items per minute, and speed-up against so many seconds each."""
    each = elapsed / items if items else 0.0
    return {"elapsed": elapsed, "per_item": each, "per_minute": 60 / each if each else 0.0, "speedup": items * sequential_each / elapsed if elapsed else 0.0}


def ranking_report(judgments: DataFrame, task: str, name_a: str, name_b: str, elapsed: float, concurrent: int = 1, frames: int = 0) -> DataFrame:
    """One row for a run of comparisons (winner, success): task, names, time and throughput, win_rates' counts and rates, and how it was run."""
    n = F.col("total")
    rows = win_rates(judgments)
    return rows.select(
        F.lit(task).alias("task"), F.lit(name_a).alias("model_a"), F.lit(name_b).alias("model_b"), F.lit(elapsed).alias("elapsed_time"), ratio(F.lit(elapsed), n).alias("avg_per_comparison"), ratio(n * 60, F.lit(elapsed)).alias("throughput"),
        F.col("a_wins").alias("wins_a"), F.col("b_wins").alias("wins_b"), "ties", "errors", "win_rate_a", "win_rate_b", "tie_rate", F.lit(concurrent).alias("concurrent"), F.lit(frames).alias("video_frames"), F.lit(frames > 0).alias("video_aware"),
    )


def save_ranking(judgments: DataFrame, summary: DataFrame, output: str) -> None:
    """Both as JSON: detailed_results, a line for each comparison, and summary, one line."""
    judgments.write.mode("overwrite").json(f"{output}/detailed_results")
    summary.coalesce(1).write.mode("overwrite").json(f"{output}/summary")
