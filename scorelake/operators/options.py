"""The best of many options for each of many rows, by the dot product of vectors.

Few options (a checked size) go to every task. Beyond that the work is a grid: options are dealt to blocks by a hash, each different vector of rows meets each block once, a cell's products are one matrix product's
worth of work, and what a cell keeps for a vector is its best option; these are reduced by max_by. No option table is held whole anywhere, and rows themselves aren't copied: their different vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.temporal import dot

#: Numbers in the vectors of options up to which they go to every task (8 bytes each); options of a block, about; vectors that are compared with a block at once; digits after the point that products are told apart by.
SENT, BLOCK, ROWS, DIGITS = 1 << 18, 2048, 256, 9


def usable(vector: Column) -> Column:
    """The vector as doubles, or null if it, or one of its components, is null or isn't finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~F.exists(vector, bad), F.transform(vector, lambda x: x.cast("double")))


def nearest_option(rows: DataFrame, vector: str, options: DataFrame, option_id: str, option_vector: str, sent: int = SENT, block: int = BLOCK) -> DataFrame:
    """rows with choice, the option_id (an integer) of the largest dot product, and sim, that product to DIGITS places; the smallest id among equals.

    A vector that is null, or has a null or infinite component or one that is no number, has no choice, and can't be one; nor do vectors of different lengths meet. Repeated options count once, rows stay as they are. Rows
    without a choice have nulls; so have all if there are no options. sent and block change no result."""
    known = options.select(F.col(option_id).cast("long").alias("i"), usable(F.col(option_vector)).alias("v")).filter("i is not null and v is not null").distinct()
    count, numbers = known.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()
    own = rows.withColumn("__x", usable(F.col(vector)))
    if numbers <= sent:
        return _sent(own, known)
    blocks = max(1, -(-count // block))
    return _grid(own, known.withColumn("block", F.pmod(F.xxhash64("i", "v"), F.lit(blocks)).cast("int")), blocks)


def _sent(rows: DataFrame, known: DataFrame) -> DataFrame:
    """All options in one row, whose size has been checked, beside each row."""
    listed = known.agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("__options"))
    best = F.array_max(F.filter(F.transform("__options", lambda o: F.struct(F.round(dot(F.col("__x"), o["v"]), DIGITS).alias("sim"), (-o["i"]).alias("i"))), lambda s: s["sim"].isNotNull()))
    scored = rows.join(F.broadcast(listed)).withColumn("__best", best)
    return scored.withColumns({"choice": -F.col("__best.i"), "sim": F.col("__best.sim")}).drop("__options", "__best", "__x")


def _grid(rows: DataFrame, known: DataFrame, blocks: int) -> DataFrame:
    """Each block of options beside each different vector. A cell is one block and one share of the vectors, so it has a bounded number of options, and vectors are read in batches."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-parts // blocks))  # with few blocks, a block's vectors are dealt to several cells
    vectors = rows.select("__x").filter("__x is not null").distinct().withColumn("share", F.pmod(F.xxhash64("__x", F.lit(1)), F.lit(shares)).cast("int"))
    sides = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "share", F.lit(None).cast("long").alias("i"), F.col("__x").alias("v"))
    held = known.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "i", "v")
    # a cell's options come before its vectors, so one pass over a partition holds one block
    met = held.union(sides).repartition(min(blocks * shares, 4 * parts), "block", "share").sortWithinPartitions("block", "share", F.col("i").isNull(), "i")
    found = met.mapInArrow(_cells, "v array<double>, i long, sim double")
    # the runner-ups that a cell keeps differ by less than the last digit, so that rounding is Spark's on both ways
    best = found.select("v", F.struct(F.round("sim", DIGITS).alias("sim"), (-F.col("i")).alias("i")).alias("s")).groupBy("v").agg(F.max("s").alias("__best"))
    scored = rows.join(best.withColumnRenamed("v", "__x"), "__x", "left")
    return scored.withColumns({"choice": -F.col("__best.i"), "sim": F.col("__best.sim")}).select(*[c for c in rows.columns if c != "__x"], "choice", "sim")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best options of each cell for its vectors; rows (block, share, i, v) come cell by cell, options first."""
    cell: tuple[int, int] | None = None
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
    for batch in batches:
        part = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)  # ids beyond 2^53 stay whole
        for at, own in part.groupby(["block", "share"], sort=True):
            if at != cell:
                cell, ids, vectors, by_length = at, [], [], None
            listed = own["i"].notna()
            ids += own["i"][listed].astype("int64").tolist()
            vectors += own["v"][listed].tolist()
            queries = own["v"][~listed].tolist()
            if not queries:
                continue
            if by_length is None:
                by_length = _stacked(ids, vectors)
            for start in range(0, len(queries), ROWS):
                yield _bests(queries[start : start + ROWS], by_length)


def _stacked(ids: list[int], vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = np.array([ids[k] for k in at]), np.array([vectors[k] for k in at], float).reshape(len(at), int(n))
    return out


def _bests(queries: list[np.ndarray], by_length: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(v, i, sim): for each vector, the option of the largest product, and those of smaller ids within a unit of the last digit of it."""
    out: list[tuple[np.ndarray, int, float]] = []
    for n in {len(q) for q in queries}:
        if n not in by_length:
            continue
        mine = [q for q in queries if len(q) == n]
        ids, held = by_length[n]
        x = np.array(mine, float).reshape(len(mine), n)
        sims = np.zeros((len(mine), len(ids)))
        for d in range(n):  # in the order of the components, as the plain way adds them, so that both give the same bits
            sims += x[:, d, None] * held[None, :, d]
        top = sims.max(1)
        for q, row, high in zip(mine, sims, top, strict=True):
            near = np.flatnonzero(row >= high - 2 * 10.0**-DIGITS)
            near = near[np.lexsort((ids[near], -row[near]))]
            least = np.minimum.accumulate(ids[near])
            for k in near[np.concatenate([[True], ids[near][1:] < least[:-1]])]:
                out.append((q, int(ids[k]), float(row[k])))
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.float64())), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["v", "i", "sim"])
