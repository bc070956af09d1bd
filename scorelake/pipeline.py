"""From a configuration to results: load, answer, store, score, report."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.adapters import model_for, with_prompts
from scorelake.config import Config
from scorelake.evaluators import evaluator_for, judged_evaluator, main_metric
from scorelake.operators import report
from scorelake.sources import loaders

log = logging.getLogger("scorelake")
FACTS = "model string, dataset string, evaluator string, task string, source string, metric string, value double, error string"


@dataclass
class Benchmark:
    """Runs models on datasets and scores them. Predictions and results are Parquet under output, partitioned by model and dataset: a later run of another pair overwrites nothing."""

    spark: SparkSession
    config: Config
    output: str

    def predict(self, model: str, dataset: str) -> DataFrame:
        """Samples with predictions: stored ones, or the model's replies to their prompts."""
        spec = self.config.dataset(dataset)
        samples = loaders.load(self.spark, spec, check_files=spec.extra.get("check_files", True))
        if not spec.load_predictions_from_file:
            samples = self.adapter(model).answer(with_prompts(samples).drop("prediction"), "prediction")
        return samples.withColumns({"model": F.lit(model), "dataset": F.lit(dataset)})

    def adapter(self, model: str):
        own = self.config.model(model)
        return model_for(own.type if own.type not in ("", "rule") else own.name, own.settings)

    def store(self, predictions: DataFrame, model: str, dataset: str) -> DataFrame:
        path = f"{self.output}/predictions/model={model}/dataset={dataset}"
        predictions.drop("model", "dataset").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).withColumns({"model": F.lit(model), "dataset": F.lit(dataset)})

    def predicted(self, model: str, dataset: str) -> DataFrame:
        """A model's stored predictions on a dataset; made and stored where there are none."""
        path = f"{self.output}/predictions/model={model}/dataset={dataset}"
        if not self._exists(path):
            return self.store(self.predict(model, dataset), model, dataset)
        return self.spark.read.parquet(path).withColumns({"model": F.lit(model), "dataset": F.lit(dataset)})

    def score(self, samples: DataFrame, model: str, dataset: str, evaluator: str) -> DataFrame:
        own = self.config.evaluator(evaluator)
        judged = judged_evaluator(own.name, own.type)
        if judged:
            rows = judged(samples, self.adapter(own.get("judge", "http")), own.settings | ({"vlm_adapter": self.adapter(own.get("vlm"))} if own.get("vlm") else {}))
        else:
            rows = evaluator_for(own.name, own.type)(samples)
        return rows.select(F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), F.lit(evaluator).alias("evaluator"), "task", "source", "metric", "value", F.lit(None).cast("string").alias("error"))

    def run(self, models: list[str], datasets: list[str], evaluators: list[str] | None = None) -> DataFrame:
        """Rows of FACTS, also written under results. A failing model, dataset or evaluator gives a row with an error and the value 0 for each evaluator that it concerns, and the rest goes on."""
        pairs = [(model, dataset) for model in models for dataset in datasets]
        began = time.monotonic()
        for n, (model, dataset) in enumerate(pairs):
            samples, why = None, None
            try:
                samples = self.store(self.predict(model, dataset), model, dataset)
            except Exception as error:  # noqa: BLE001  one pair's failure is its own
                log.warning("%s on %s: %s", model, dataset, error)
                why = error
            for evaluator in evaluators or []:
                path = f"{self.output}/results/model={model}/dataset={dataset}/evaluator={evaluator}"
                columns = ["task", "source", "metric", "value", "error"]
                try:
                    if why is not None:
                        raise why
                    self.score(samples, model, dataset, evaluator).select(*columns).write.mode("overwrite").parquet(path)
                except Exception as error:  # noqa: BLE001  one evaluator's failure is its own
                    log.warning("%s on %s of %s: %s", evaluator, dataset, model, error)
                    failed = [(None, None, "score", 0.0, str(error)[:500])]
                    self.spark.createDataFrame(failed, "task string, source string, metric string, value double, error string").write.mode("overwrite").parquet(path)
            log.info("%s", report.progress(n + 1, len(pairs), time.monotonic() - began))
        return self.results() if evaluators else self.spark.createDataFrame([], FACTS)

    def cached(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table stored under a key; made and stored where there is none."""
        path = f"{self.output}/cache/{key}"
        if not self._exists(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear_cache(self, pattern: str = "*") -> int:
        """Deletes the stored tables whose key matches; returns their number."""
        fs, folder = self._folder(f"{self.output}/cache")
        found = list(fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)) or [])
        return sum(fs.delete(f.getPath(), True) for f in found)

    def _folder(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._folder(f"{path}/_SUCCESS")
        return fs.exists(target)

    def save_dated(self, rows: DataFrame, name: str) -> str:
        """Writes rows under a name with the time; returns the path."""
        path = f"{self.output}/{name}_{time.strftime('%Y%m%d_%H%M%S')}"
        rows.write.json(path)
        return path

    def results(self) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.output}/results").parquet(f"{self.output}/results")
        return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FACTS.split(", ")])

    def summary(self) -> DataFrame:
        """The pivot of each evaluator's main overall metric; of an evaluator without a declared one, the first by name. One that failed has its 0."""
        overall = self.results().filter(F.col("task").isNull() | (F.col("task") == "OVERALL"))
        main = {n: m for n, own in self.config.evaluators.items() if (m := main_metric(own.name, own.type))}
        declared = F.create_map(*[F.lit(x) for pair in main.items() for x in pair])[F.col("evaluator")] if main else F.lit(None).cast("string")
        first = F.struct((F.col("metric") != F.coalesce(declared, F.lit(""))).alias("other"), F.col("metric").alias("name"))
        best = overall.groupBy("model", "dataset", "evaluator").agg(F.min_by("value", first).alias("value")).withColumn("metric", F.lit("score"))
        return report.pivot(best)

    def save_summary(self) -> str:
        """The summary as one JSON file beside the results; returns its folder. It has a row for each model and dataset."""
        path = f"{self.output}/summary"
        self.summary().coalesce(1).write.mode("overwrite").json(path)
        return path

    def html(self, title: str = "Results") -> str:
        """The report as a page; the tables of results have a row for each metric, not for each sample."""
        rows = lambda frame: [r.asDict() for r in frame.collect()]
        return report.page(title, rows(self.summary().orderBy("model")), rows(self.results().orderBy("model", "dataset", "evaluator", "metric")))
