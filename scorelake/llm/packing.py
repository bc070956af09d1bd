"""Operator 7: best-fit packing of token sequences with large-item matching.

Lengths are integers of at most the capacity, so the number of items per length, at most one count for each length, says all that a
packing depends on. Only these counts come to the driver (capacity of them at most, however many documents there are). There
the bins are planned in bulk: full items stand alone; items above one third of the capacity fill a bin in pairs at most, so each
largest is matched greedily with the largest that still fits beside it; smaller ones go, longest first, into the tightest remaining gap.

The plan says which ranks of which length go to which run of equal bins. It has few rows: each bin pattern is touched again only by
a length that fits its gap, which then falls below that length, and at least halves; so a run of bins has at most log2(capacity) entries
and there are no more runs than the lengths made. Items get their rank within their length from counts per block of
documents, so that a length that a third of all documents share is never gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.byte_bpe import coder
from scorelake.llm.common import partitions, spare, written

PIECES = "piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first long, last long, per_bin long, sequence_base long, offset_base long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and if they don't go evenly, a shorter first one."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens of each document's ids and its end token, with the unsigned CRC-32 of their ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = coder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows: list[tuple] = []
                for key, text in zip(part.column(0), part.column(1), strict=True):
                    ids = bpe.encode_fast(text.as_py() or "") + end
                    for piece, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((key.as_py(), piece, start, n, zlib.crc32(own), *([own] if keep_ids else [])))
                columns = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [part.schema.field(0).type, *types], strict=True)], names=[id_column, *names])

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    plain = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"`{id_column}` {plain.schema[0].dataType.simpleString()}, {PIECES}" + ", ids binary" * keep_ids)


class _Gaps:
    """Runs of equal bins by the gap that they have left."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, base: int, bins: int) -> None:
        if gap and bins:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.sizes, gap)
            self.runs[gap].append((base, bins))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Takes the run of bins with the smallest gap of at least this length: gap, base, bins."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        base, bins = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.pop(at)
        return gap, base, bins


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN for the number of items of each length.

    Items of a length with a rank from first to last (exclusive) go per_bin to a bin: that of rank first + i is in bin
    sequence_base + i // per_bin at offset_base + (i % per_bin) * length.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps, bins = _Gaps(), 0

    def put(length: int, items: int, per_bin: int, base: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + items, per_bin, base, offset))
        used[length] += items

    large = sorted(n for n in left if 3 * n > capacity)
    remaining = {n: left[n] for n in large}
    while large:
        a = large[-1]
        n = remaining[a]
        fit = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside it
        b = large[fit] if fit >= 0 else None
        if b == a and n == 1:
            b = large[fit - 1] if fit >= 1 else None
        if b is None:
            put(a, n, 1, bins, 0)
            gaps.add(capacity - a, bins, n)
            bins += n
            remaining[a] = 0
        elif b == a:
            put(a, n // 2 * 2, 2, bins, 0)
            gaps.add(capacity - 2 * a, bins, n // 2)
            bins += n // 2
            remaining[a] = n % 2
        else:
            m = min(n, remaining[b])
            put(a, m, 1, bins, 0)
            put(b, m, 1, bins, a)
            gaps.add(capacity - a - b, bins, m)
            bins += m
            remaining[a] -= m
            remaining[b] -= m
        large = [x for x in large if remaining[x]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[length]
        while n:
            found = gaps.tightest(length)
            if found is None:
                each = capacity // length
                whole, over = divmod(n, each)
                found = (capacity, bins, whole + bool(over))
                bins += found[2]
            gap, base, here = found
            each = gap // length  # a bin that took one is then the tightest for the next
            whole = min(here, n // each)
            if whole:
                put(length, whole * each, each, base, capacity - gap)
                gaps.add(gap - each * length, base, whole)
                n -= whole * each
            if whole < here:
                rest = here - whole
                if n:  # fewer than fill one bin
                    put(length, n, n, base + whole, capacity - gap)
                    gaps.add(gap - n * length, base + whole, 1)
                    rest -= 1
                    n = 0
                gaps.add(gap, base + here - rest, rest)
    return rows


def pack(pieces: DataFrame, capacity: int, id_column: str = "doc_id") -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32, any others) with sequence_id long and offset long.

    pieces must be a stored table: it is read twice and must give the same rows. Repeated rows each get a place of their own.
    """
    spark = pieces.sparkSession
    block, within, below, first, last, per, base, at, size = spare(pieces.columns, "block", "within", "below", "first", "last", "per_bin", "sequence_base", "offset_base", "plan_length")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # no more rows than the capacity
    planned = spark.createDataFrame(plan(counts, capacity), PLAN).toDF(size, first, last, per, base, at)
    blocks = max(1, 4 * partitions(spark))
    placed = pieces.withColumn(block, F.pmod(F.xxhash64(id_column, "piece", "ids_crc32"), F.lit(blocks)))
    start = placed.groupBy("length", block).count().withColumn(below, F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    order = [F.col(c) for c in (id_column, "piece", "ids_crc32")]
    ranked = placed.withColumn(within, F.row_number().over(Window.partitionBy("length", block).orderBy(*order)) - 1)
    ranked = ranked.join(start, ["length", block]).withColumn(within, F.col(within) + F.col(below))
    # the plan's size is bounded by the capacity, see above
    found = ranked.join(F.broadcast(planned), (F.col("length") == F.col(size)) & (F.col(within) >= F.col(first)) & (F.col(within) < F.col(last)))
    i = F.col(within) - F.col(first)
    return found.select(
        *[F.col(f"`{c}`") for c in pieces.columns], (F.col(base) + F.floor(i / F.col(per))).cast("long").alias("sequence_id"), (F.col(at) + i % F.col(per) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most capacity tokens; one row per piece: id, piece int (from 0), start long (its
    document's tokens before it), length long, ids_crc32 long, ids binary (with keep_ids), sequence_id long, offset long.

    A document is its ids and end_id; only one of more than capacity tokens is cut. A null or empty text is its end token alone.
    Repeated rows (even with equal ids) are packed each; null ids are kept; other columns are ignored. An empty table gives no rows.
    """
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, keep_ids, id_column, text_column), "pieces"), capacity, id_column)
