"""Operator 12: importance resampling towards a target distribution, by array-scored weights and a merge of sorted runs.

1. Words (or runs of words) of all documents and of the target texts are counted by hashed buckets: one partial sum for each task and bucket. Each bucket's gain,
   the logarithm of how much more frequent it is in the target, goes into one array; its length is a parameter, so the array has a proven bound.
2. Each document's weight is the mean gain of its buckets, read from the array. Its score is weight and noise that its id decides. Weights and scores are written; texts are read no further.
3. Scores are integers in a range that the gains bound (a gain lies within 1000 times the logarithm of a count), so how many documents have each score is counted exactly, and cut into ranges of about equally many
   documents to draw, each with the rank at which it begins.
4. Eligible documents are sorted in their partitions. Each of these runs is cut into blocks at the ranges' ends and written.
5. Each range merges its blocks by a tournament tree over the open runs. Blocks come in the order of their first rows, so a run has one open block at most, whatever the length of the runs. The merge gives out ranks and stops at the exact number
   to draw; ranges beyond are never read.

Lost executors cost the tasks that they ran: weights and runs are tables in the shared folder, and a row's number is written with its score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import partitions, written

#: A-Z become a-z, all other ASCII characters but digits and a-z become spaces; bytes of longer characters stay, so that words can be cut from UTF-8.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time, words whose buckets are kept, and the longest of them; no result depends on these.
CHUNK, CACHED, LONGEST_CACHED = 1 << 20, 500_000, 64
#: Rows of a block of a run, and documents to draw of which a range is made at least.
BLOCK, LEAST = 4096, 4096


class Buckets(dict):
    """Buckets of features by their bytes; starts afresh when full."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.size
        if len(feature) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[feature] = bucket
        return bucket

    def of(self, text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """How many words a part of a text has, and the buckets of the runs of up to longest words that end in it."""
        plain, at, before = text.translate(LOWERED), 0, []
        while at < len(plain):
            to = plain.find(b" ", at + CHUNK)
            to = len(plain) if to < 0 else to
            words = plain[at:to].split()
            at = to
            features = words
            if longest > 1:
                all_words = before + words
                features = [b" ".join(all_words[i - n : i]) for i in range(len(before) + 1, len(all_words) + 1) for n in range(1, min(longest, i) + 1)]
                before = all_words[-(longest - 1) :]
            yield len(words), np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, size: int, longest: int, text_column: str) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row for each bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, sums = Buckets(size), np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in buckets.of(text.as_py() or b"", longest):
                    sums += np.bincount(found, minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    rows = texts.select(F.col(text_column).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, floored; one is added to each count."""
    size, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_raw + size) / (float(s + 1) * float(all_target + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int, seed: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n_words, n_features, weight, score, row): row numbers are the table's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(len(gains))
        for batch in batches:
            words, features, weights = [], [], []
            for text in batch.column(1):
                n_words = n = total = 0
                for n_own, found in buckets.of(text.as_py() or b"", longest):
                    n_words, n, total = n_words + n_own, n + len(found), total + int(gains[found].sum())
                words.append(n_words)
                features.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))], names=["id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    found = plain.mapInArrow(run, f"id {plain.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    return found.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())


def ranges_of(levels: dict[int, int], draw: int, per_range: int) -> tuple[list[int], list[int]]:
    """The lowest score of each range, from the highest on, and how many documents stand before it. The last one holds the score at which the draw ends."""
    lowest, before, seen, own = [], [], 0, 0
    for score in sorted(levels, reverse=True):
        if seen >= draw:
            break
        if own == 0:
            before.append(seen)
            lowest.append(score)
        own += levels[score]
        seen += levels[score]
        lowest[-1] = score
        if own >= per_range:
            own = 0
    return lowest, before


KEPT = ["id", "row", "n_features", "weight", "score"]


def sorted_runs(eligible: DataFrame, lowest: list[int]) -> DataFrame:
    """Each partition's rows as one run, sorted by score (highest first), id (null last) and row, in blocks that end where ranges do: (range, run, score, first_id, first_row, rows)."""
    falling = -np.array(lowest, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        for batch in batches:
            place = np.searchsorted(falling, -np.asarray(batch.column("score")))  # of the first range whose lowest score isn't above
            cuts = sorted({*range(0, batch.num_rows, BLOCK), *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows})
            starts = pa.array(cuts[:-1])
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(c)) for c in KEPT]
            yield pa.RecordBatch.from_arrays([pa.array(place[cuts[:-1]], pa.int64()), pa.array([own] * len(starts), pa.int64()), batch.column("score").take(starts), batch.column("id").take(starts), batch.column("row").take(starts), *lists], names=["range", "run", "first_score", "first_id", "first_row", *KEPT])

    kind = eligible.schema["id"].dataType.simpleString()
    schema = f"range long, run long, first_score long, first_id {kind}, first_row long, id array<{kind}>, row array<long>, n_features array<long>, weight array<long>, score array<long>"
    return eligible.select(*KEPT).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("id"), "row").mapInArrow(run, schema)


class Tournament:
    """A tree of matches between the first rows of open blocks: the least key wins. Each run has one leaf; the tree doubles as runs come."""

    def __init__(self):
        self.leaves, self.of_run, self.tree, self.blocks = 1, {}, [END, END], []

    def enter(self, run: int, keys: list[tuple], block: int) -> None:
        """A run's next block: its keys in order. The run's former block has been emptied by then."""
        leaf = self.of_run.setdefault(run, len(self.of_run))
        if leaf >= self.leaves:
            held = self.tree[self.leaves :]
            self.leaves *= 2
            self.tree = [END] * self.leaves + held + [END] * (self.leaves - len(held))
            for i in range(self.leaves - 1, 0, -1):
                self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])
        while len(self.blocks) <= leaf:
            self.blocks.append(None)
        self.blocks[leaf] = [keys, block, 0]
        self._play(leaf, (keys[0], leaf))

    def _play(self, leaf: int, entry: tuple) -> None:
        at, tree = self.leaves + leaf, self.tree
        tree[at] = entry
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    @property
    def best(self) -> tuple:
        return self.tree[1][0]

    def pop(self) -> tuple[int, int]:
        """The winner's block and place in it; the run's next row takes its leaf."""
        leaf = self.tree[1][1]
        keys, block, at = self.blocks[leaf]
        self.blocks[leaf][2] = at + 1
        self._play(leaf, (keys[at + 1], leaf) if at + 1 < len(keys) else END)
        return block, at


#: Behind all keys, which begin with the score below nought.
END = ((math.inf,), -1)


def merged(blocks: DataFrame, before: list[int], draw: int, parts: int) -> DataFrame:
    """(id, row, n_features, weight, score, rank) of all rows of the ranges; rows beyond the draw have no rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree, open_blocks, out, rank, left = None, None, {}, {c: [] for c in (*KEPT, "rank")}, 0, 0

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[c], types[c]) for c in out], names=list(out))
            for c in out:
                out[c].clear()
            return made

        def until(limit: tuple) -> None:
            nonlocal rank, left
            while tree.best < limit:
                block, at = tree.pop()
                columns = open_blocks[block]
                for c in KEPT:
                    out[c].append(columns[c][at])
                rank, left = rank + 1, left - 1
                out["rank"].append(rank if left >= 0 else None)  # the draw has ended
                if at + 1 == len(columns["id"]):
                    del open_blocks[block]

        number = 0
        for batch in batches:
            types = {c: batch.schema.field(c).type.value_type for c in KEPT} | {"rank": pa.int64()}
            for i in range(batch.num_rows):
                place = batch.column("range")[i].as_py()
                if place != current:
                    if tree is not None:
                        until(END[0])
                    current, tree, rank, left = place, Tournament(), before[place], draw - before[place]
                columns = {c: batch.column(c)[i].as_py() for c in KEPT}
                keys = [(-s, x is None, x, r) for s, x, r in zip(columns["score"], columns["id"], columns["row"], strict=True)]
                until(keys[0])  # all that comes later begins behind this block's first row
                number += 1
                open_blocks[number] = columns
                tree.enter(batch.column("run")[i].as_py(), keys, number)
                if len(out["rank"]) >= BLOCK:
                    yield given()
        if tree is not None:
            until(END[0])
            yield given()

    kind = blocks.schema["first_id"].dataType.simpleString()
    dealt = blocks.filter(F.col("range") < len(before)).repartition(parts, "range").sortWithinPartitions("range", F.desc("first_score"), F.asc_nulls_last("first_id"), "first_row")
    return dealt.mapInArrow(run, f"id {kind}, row long, n_features long, weight long, score long, rank long")


def resample(docs: DataFrame, target: DataFrame, size: int = 10_000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """Per row of docs: the id column, n_features, weight, score, rank long. Of the rows with at least least_words words, the highest scores (percent of them, floored) are drawn; others have no rank.

    A null text is an empty one, with no features and weight 0. Equal scores go by id, a null id last; rows of one id are told apart by their place in the table, and have one noise.
    Noise of a null id is that of an empty one. Without documents nothing is returned; without target texts all of them count as empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    gains = gains_of(bucket_counts(docs, size, longest, text_column), bucket_counts(target, size, longest, target_column))
    scored = written(weighed(docs, gains, longest, seed, id_column, text_column), "weights")
    eligible = scored.filter(F.col("n_words") >= least_words)
    levels = {r.score: r.n for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()}
    draw = sum(levels.values()) * percent // 100
    names = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    unranked = [*names, F.lit(None).cast("long").alias("rank")]
    if not draw:
        return scored.select(*unranked)
    lowest, before = ranges_of(levels, draw, max(LEAST, -(-draw // partitions(spark))))
    drawn = merged(written(sorted_runs(eligible, lowest), "runs"), before, draw, len(lowest))
    rest = scored.filter((F.col("n_words") < least_words) | (F.col("score") < lowest[-1]))
    return drawn.select(*names, "rank").union(rest.select(*unranked))
