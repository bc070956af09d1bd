"""The cube of results: (model, dataset, evaluator, metric, value) rows, its pivot, rankings and renderings."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUBE = "model string, dataset string, evaluator string, metric string, value double, error string"


def pivot(cube: DataFrame, metric: str = "score") -> DataFrame:
    """A row for each model, a column for each dataset_evaluator in order, cells of four decimals or N/A."""
    own = cube.filter(F.col("metric") == metric).withColumn("combo", F.concat_ws("_", "dataset", "evaluator"))
    combos = sorted(r.combo for r in own.select("combo").distinct().collect())  # the report's columns
    wide = own.groupBy("model").pivot("combo", combos).agg(F.first("value"))
    return wide.select("model", *[F.when(F.col(f"`{c}`").isNull(), "N/A").otherwise(F.format_string("%.4f", F.col(f"`{c}`"))).alias(c) for c in combos])


def ranking(scores: DataFrame, name: str = "evaluator", score: str = "score") -> DataFrame:
    """Methods by descending score, equals by name, with their place."""
    from pyspark.sql import Window

    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), name)).cast("long"))


def contents(cube: DataFrame) -> DataFrame:
    """One row: the sorted names of models, datasets and evaluators, and the number of results and errors."""
    names = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}s") for c in ("model", "dataset", "evaluator")]
    return cube.agg(*names, F.count("*").alias("results"))


def grid(rows: list[dict], columns: list[str] | None = None) -> str:
    """A table for the console."""
    columns = columns or list(rows[0] if rows else [])
    cells = [[str(r.get(c, "")) for c in columns] for r in rows]
    widths = [max(map(len, [c, *(r[i] for r in cells)])) for i, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule])


def page(title: str, summary: list[dict], details: list[dict], hidden: tuple[str, ...] = ("individual_scores",)) -> str:
    """An HTML page of the pivot and of all results; the caller has bounded both."""

    def table(rows: list[dict]) -> str:
        columns = [c for c in (rows[0] if rows else {}) if c not in hidden]
        cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
        return "<table><tr>" + "".join(cell("th", c) for c in columns) + "</tr>" + "".join("<tr>" + "".join(cell("td", r.get(c, "")) for c in columns) + "</tr>" for r in rows) + "</table>"

    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{table(summary)}{table(details)}</body></html>"


def progress(done: int, total: int, elapsed: float) -> str:
    """Share done, and about how many seconds are left."""
    left = elapsed / done * (total - done) if done else 0.0
    return f"{done}/{total} ({100 * done / total if total else 100.0:.1f} %), {elapsed:.1f} s, about {left:.1f} s left"
