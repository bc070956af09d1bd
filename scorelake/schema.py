"""Schemas of samples and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<array<struct<start:double,end:double>>>"
#: Every loader's columns; a loader fills those that its data has.
SAMPLE = {
    "id": "string", "dataset": "string", "model": "string", "image_path": "string", "video_path": "string", "prompt": "array<string>", "prediction": "array<string>", "reference_text": "array<string>", "reference_idx": "int",
    "ground_truth": "string", "gt_segments": SEGMENTS, "events": "array<string>", "pred_events": "array<string>", "options": "array<string>", "answer_text": "string", "n_subjects": "int", "n_shots": "int",
    "duration_raw": "string", "duration_s": "double", "task": "string", "source": "string", "extra": "map<string,string>", "error": "string", "pos": "bigint",
}
PER_SAMPLE = ["model", "dataset", "evaluator", "id", "task", "source", "metric", "value", "success", "error"]
OVERALL = "model string, dataset string, evaluator string, metric string, value double, error string"


def canonical(rows: DataFrame) -> DataFrame:
    """rows with all columns of SAMPLE, in order, missing ones null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in SAMPLE.items()])
