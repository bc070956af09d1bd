"""What the corpus operators share: reading tables, cutting lineage in the shared folder, row keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these six ASCII characters: \x20 and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold at most 8 MB, where the session hasn't set another size: several are held at once in the JVM and in each worker."""
    with contextlib.suppress(PySparkException):  # no such setting in this version
        if spark.conf.get(BATCH_BYTES) == DEFAULT_BYTES:
            spark.conf.set(BATCH_BYTES, "8m")


#: The setting's value in a session that hasn't set it.
DEFAULT_BYTES = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, local mode gets one of our own; a cluster, whose machines share no temporary folder, gets an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scorelake-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, what: str = "stage") -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives the loss of executors.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/scorelake/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, target = _place(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def settled(df: DataFrame, what: str = "input") -> DataFrame:
    """df itself where it is read from stored tables alone, else as a table in the shared folder: behind a shuffle, a task that runs again may get its rows in another order."""
    return written(df, what) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard(df: DataFrame) -> None:
    """Deletes a table that written has made and that nothing reads any longer."""
    system, target = _place(df.sparkSession, df.written_path)
    system.delete(target, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as two underscores) while a table is written; the former ones come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def spare(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the given ones (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
