"""Intervals, ratios and frame arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "struct<start:double,end:double>"


def f1(recall: Column, precision: Column) -> Column:
    """Harmonic mean; 0 where either isn't positive."""
    return F.when((recall <= 0) | (precision <= 0), 0.0).otherwise(2 * recall * precision / (recall + precision))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def segment(start: Column, end: Column) -> Column:
    """An interval with its ends in order; both are null if one is."""
    both = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(both, F.least(start, end)).cast("double").alias("start"), F.when(both, F.greatest(start, end)).cast("double").alias("end"))


def shared_length(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two intervals; 0 for two empty ones."""
    both = shared_length(a, b)
    return ratio(both, (a["end"] - a["start"]) + (b["end"] - b["start"]) - both)


def hull_iou(a: Column, b: Column) -> Column:
    """Intersection over the smaller of the hull and both lengths, with a small constant under it."""
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return shared_length(a, b) / (F.least(hull, (a["end"] - a["start"]) + (b["end"] - b["start"])) + F.lit(1e-8))


def best_iou(span: Column, others: Column) -> Column:
    """Largest IoU with any of an array of intervals; 0 if there are none."""
    return F.coalesce(F.array_max(F.transform(others, lambda o: iou(span, o))), F.lit(0.0))


def slots(spans: Column, limit: int = 1000) -> Column:
    """The one-second slots that intervals cover, up to a limit: from the rounded start (not below 0) up to the rounded end, exclusive. Halves round to even."""
    start = lambda s: F.greatest(F.lit(0), F.rint(s["start"]).cast("int"))
    end = lambda s: F.least(F.lit(limit), F.rint(s["end"]).cast("int"))
    own = lambda s: F.when(end(s) > start(s), F.sequence(start(s), end(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(spans, own)))


def linspace_frames(total: Column, n: int) -> Column:
    """n frame numbers from the first to the last, evenly, both included; all frames if there are no more than n."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / F.lit(max(1, n - 1))).cast("int"))
    return _frames(total, n, steps)


def stride_frames(total: Column, n: int) -> Column:
    """Frame numbers int(i * total / n)."""
    return _frames(total, n, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * total / F.lit(n)).cast("int")))


def rounded_frames(total: Column, n: int) -> Column:
    """Evenly spaced frame numbers, rounded to the nearest (halves to even)."""
    return _frames(total, n, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (total - 1) / F.lit(float(max(1, n - 1)))).cast("int")))


def _frames(total: Column, n: int, many: Column) -> Column:
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= n, F.sequence(F.lit(0), total - 1)).otherwise(many)


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(0.0)


def clock_seconds(text: Column) -> Column:
    """Seconds of `12.5`, `mm:ss` or `hh:mm:ss`; null for anything else."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda t, p: t * 60 + p)
    return F.when(F.size(parts) <= 3, total)


def fitted(width: Column, height: Column, largest: int = 512) -> Column:
    """(width, height) scaled down, by whole pixels, so that the longer side is at most largest."""
    scale = F.least(F.lit(1.0), F.lit(float(largest)) / F.greatest(width, height))
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def cache_key(model: Column, dataset: Column, config_json: Column) -> Column:
    """model_dataset_ and the first eight hexadecimal digits of the MD5 of the configuration (JSON with sorted keys)."""
    return F.concat_ws("_", model, dataset, F.substring(F.md5(config_json), 1, 8))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
