"""Replies that outlive a run: a table of what a judge or model has said, to which runs append and of which they ask only what is missing.

A request's key is its sample, the judge's name, and a hash of its prompt and media. Missing requests are asked slice by slice; a slice is one Spark job, whose replies are appended when it
has ended, by Spark's commit of its files. So a run that breaks off keeps its slices, and a task that is tried again leaves no second row. Errors are told, but asked again by the next run.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "judge string, sample string, request string, reply string, failed boolean, run string"
#: Columns that name a sample, the first that requests have.
SAMPLES = ["id", "sample_id"]


def _hash(value: Column) -> Column:
    return F.sha2(F.to_json(value), 256)


@dataclass
class Resumable:
    """An adapter whose replies are kept in a table (path, on a file system that all machines share). at_once: requests of a slice, about; slices are asked one after the other."""

    adapter: object
    path: str
    judge: str
    at_once: int = 2000

    def stored(self, spark: SparkSession) -> DataFrame:
        """All replies and errors of this judge."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("judge") == self.judge)

    def answer(self, requests: DataFrame, out: str = "reply", prompt: str = "prompt", media: str | None = None, accept=None) -> DataFrame:
        """As the adapter's. Asks what isn't stored, and then reads the table; equal requests of a sample are one. Requests without a sample column share replies by prompt and media alone."""
        spark = requests.sparkSession
        many = requests.schema[prompt].dataType.simpleString().startswith("array")
        name = next((c for c in SAMPLES if c in requests.columns), None)
        sample = F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")
        asked = F.struct(F.col(f"`{prompt}`").alias("prompt"), *([F.col(f"`{media}`").alias("media")] if media else []))
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # grows from run to run
        keyed = self._settled(requests.withColumn("_sample", sample).withColumn("_request", _hash(asked)), run)
        self._ask(keyed, prompt, media, accept, run)
        known = self.stored(spark).groupBy(F.col("sample").alias("_sample"), F.col("request").alias("_request"))
        # a reply, however often it was asked for, is one; without any, the last run's error
        kept = known.agg(F.min(F.when(~F.col("failed"), F.col("reply"))).alias("_good"), F.max_by("reply", "run").alias("_last")).select("_sample", "_request", F.coalesce("_good", "_last").alias("_told"))
        told = F.from_json("_told", "array<string>") if many else F.get(F.from_json("_told", "array<string>"), 0)
        return keyed.join(kept, ["_sample", "_request"], "left").withColumn(out, told).drop("_sample", "_request", "_told")

    def missing(self, keyed: DataFrame) -> DataFrame:
        have = self.stored(keyed.sparkSession).filter(~F.col("failed")).select(F.col("sample").alias("_sample"), F.col("request").alias("_request")).distinct()
        return keyed.dropDuplicates(["_sample", "_request"]).join(have, ["_sample", "_request"], "left_anti")

    def _settled(self, keyed: DataFrame, run: str) -> DataFrame:
        """The requests as a table beside the replies, until the application ends: what they come from may be another model's replies, and isn't asked again for each slice."""
        spark, path = keyed.sparkSession, f"{self.path.rstrip('/')}-requests/{run}"
        keyed.write.parquet(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        return spark.read.schema(keyed.schema).parquet(path)

    def _ask(self, keyed: DataFrame, prompt: str, media: str | None, accept, run: str) -> None:
        fields = [F.col(f"`{c}`") for c in dict.fromkeys(["_sample", "_request", prompt, *([media] if media else [])])]
        slices = max(1, -(-self.missing(keyed.select(*fields)).count() // self.at_once))
        for n in range(slices):
            own = self.missing(keyed.select(*fields)).filter(F.pmod(F.xxhash64("_sample", "_request"), F.lit(slices)) == n)
            told = self.adapter.answer(own, "_reply", prompt, media, accept)
            many = told.schema["_reply"].dataType.simpleString().startswith("array")
            texts = F.col("_reply") if many else F.array("_reply")
            failed = F.col("_reply").isNull() | F.exists(texts, lambda x: x.isNull() | x.startswith("[Error"))
            told.select(F.lit(self.judge).alias("judge"), F.col("_sample").alias("sample"), F.col("_request").alias("request"), F.to_json(texts).alias("reply"), failed.alias("failed"), F.lit(run).alias("run")).write.mode("append").parquet(self.path)

