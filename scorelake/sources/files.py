"""File listings as tables, and samples whose file is there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.text import encoded


def plain_path(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:/+", "/")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder; none if it isn't there. The files' contents are not read."""
    empty = spark.createDataFrame([], "path string, length long")
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    except AnalysisException:
        return empty
    return found.select(plain_path(F.col("path")).alias("path"), "length")


def present(samples: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Samples whose path is in the listing."""
    return samples.join(files.select(F.col("path").alias(column)), column, "left_semi")


def missing(samples: DataFrame, files: DataFrame, column: str) -> DataFrame:
    return samples.join(files.select(F.col("path").alias(column)), column, "left_anti")


def structure(spark: SparkSession, folder: str, annotation: str | None = None) -> DataFrame:
    """(kind, name, n): annotation files of known names, image folders with their number of images, and what is amiss (issue, suggestion)."""
    # The names by which annotation files and image folders are known.
    names = [annotation] * bool(annotation) + ["annotations.json", "captions.json", "data.json", "dataset.json"]
    folders = ["images", "imgs", "pictures", "data"]
    root = folder.rstrip("/")
    inside = listing(spark, root).withColumn("rest", F.substring("path", F.lit(len(root) + 2), F.length("path")))
    notes = inside.filter(F.col("rest").isin(names)).select(F.lit("annotation").alias("kind"), F.col("rest").alias("name"), F.lit(1).cast("long").alias("n"))
    images = inside.filter(F.lower("rest").rlike(r"^[^/]+/[^/]+\.(jpg|jpeg|png)$")).groupBy(F.split("rest", "/")[0].alias("name")).agg(F.count("*").alias("n")).filter(F.col("name").isin(folders))
    images = images.select(F.lit("images").alias("kind"), "name", "n")
    found = notes.union(images)
    kinds = {r.kind for r in found.select("kind").distinct().collect()}
    amiss = []
    if "annotation" not in kinds:
        amiss += [("issue", "no annotation file", 0), ("suggestion", f"create one of {', '.join(names)}", 0)]
    if "images" not in kinds:
        amiss += [("issue", "no image folder", 0), ("suggestion", f"create {folders[0]}", 0)]
    return found.union(spark.createDataFrame(amiss, "kind string, name string, n long"))


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content binary, encoded string) of the files under a folder: their bytes, and these in base64."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return read.select("path", "content", encoded(F.col("content")).alias("encoded"))
