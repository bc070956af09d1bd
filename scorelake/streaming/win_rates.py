"""An extension: win rates over verdicts as they arrive, by category and event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions import jsons


def windowed(verdicts: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, category, total, a_wins, b_wins, ties) of a stream (ts, category, verdict_json); rows later than the watermark are left out. State is a few counts for each window and category."""
    read = verdicts.withColumn("v", jsons.verdict(F.col("verdict_json"))).withWatermark("ts", late)
    won = lambda w: F.count_if(F.col("v.winner") == w)
    return read.groupBy(F.window("ts", window), "category").agg(F.count("*").alias("total"), won("A").alias("a_wins"), won("B").alias("b_wins"), won("tie").alias("ties"))
