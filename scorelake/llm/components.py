"""Connected components of a table of links, by alternating stars: each round hangs a node's neighbours on the smallest of them.

Links that come later are contracted to the components that are known (extended), so nothing starts again from all links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import discard, settings, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest node among the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("hub"), F.least("a", "least").alias("least"))
    joined = both.filter("b > a").join(least, F.col("a") == F.col("hub"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "hub")
    joined = down.join(least, F.col("a") == F.col("hub"))
    own = least.select(F.col("hub").alias("a"), F.col("least").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").union(own).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, on which nodes hang but which hangs on none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("up")))
    # twice the number of links upwards, and one more for any downwards
    seen = ends.groupBy("id").agg((F.sum("up") * 2 + F.max(1 - F.col("up"))).alias("n")).agg(F.max("n")).first()[0]
    return seen is None or seen <= 2


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a long, b long): the smallest node of its component. Links of a node with itself and nulls count for nothing.

    A hub's neighbours meet as partial minima and in a join that Spark splits, so a component of a third of all nodes is no single task's.
    """
    with settings(edges.sparkSession, spark__sql__autoBroadcastJoinThreshold="-1"):  # each broadcast would be a job of its own, in the driver's memory
        edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        while not _are_stars(edges):
            edges, old = written(_small_star(_large_star(edges)), "stars"), edges
            discard(old)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, component), as components gives them, after further links (a, b); a node without a label is a component of its own."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    named = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    links = written(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct(), "links")
    if links.isEmpty():
        return labels
    new = written(components(links), "labels")
    renamed = new.select(F.col("id").alias("component"), F.col("component").alias("now"))
    known = labels.join(renamed, "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return written(known.union(new.join(labels.select("id"), "id", "left_anti")), "labels")
