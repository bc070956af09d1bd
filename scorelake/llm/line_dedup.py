"""Operator 9: line dedup by sharded minimal perfect hashing.

The distinct line keys of all documents are counted by hash (partial sums first). They are dealt to shards by hash, and each shard
becomes one minimal perfect hash with compact arrays: a fingerprint of 32 bits, a saturating count of documents of 8 bits, and the first
document. Documents probe these arrays: only hashes travel, never lines, and no line is joined with a line. A shard that is probed very
often (for a line that a third of all documents hold) is copied, and its probes are dealt among the copies.

Keys are told apart by 96 bits: 64 of one hash, by which the perfect hash numbers them, and 32 of another, their fingerprint. Keys that
agree in the first alone are listed beside the arrays of their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import spare, text_or_empty, written

#: Keys of a shard, about; and probes of one copy of a shard, about.
SHARD_KEYS = 1 << 17
SHARD_PROBES = 1 << 20
#: Stands for a null id, after all others.
LAST_ID = (1 << 63) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIP = " \t\n\x0b\x0c\r"
#: Spark's seed of xxhash64, what the second hash hashes first, and the seed which that leaves.
SEED, FIRST = 42, "check"
SECOND = xxhash.xxh64_intdigest(FIRST.encode(), SEED)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A hash of unsigned 64-bit keys (the finaliser of splitmix64)."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers distinct 64-bit keys from 0 on: levels of bits, each set where one key alone falls; the others go to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())
        self.size = before

    @classmethod
    def of(cls, keys: np.ndarray, space: float = 2.0) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(1, int(space * len(keys)))
            at = (_mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            keys = keys[hits[at] > 1]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 for some that aren't among them, any number for the others."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(rest):
                break
            at = (_mixed(keys[rest], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes() for bits in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in levels])


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def _hashes(text: Column, least: int) -> Column:
    """Hashes of the distinct line keys of at least so many code points."""
    keys = F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), key_of), lambda k: F.length(k) >= least))
    return F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h"), F.shiftright(F.xxhash64(F.lit(FIRST), k), 32).cast("int").alias("check")))


def without(text: str, lost: set[tuple[int, int]], least: int) -> tuple[int, int, str]:
    """How many lines a text has and keeps, and the text without those whose key's hashes (h, check) are lost."""
    lines = text.split("\n")
    kept = []
    for line in lines:
        key = line.strip(STRIP)
        if len(key) >= least:
            data = key.encode().lower()
            h, check = xxhash.xxh64_intdigest(data, SEED), xxhash.xxh64_intdigest(data, SECOND) >> 32
            if (h - (h >> 63 << 64), check - (check >> 31 << 32)) in lost:
                continue
        kept.append(line)
    return len(lines), len(kept), "\n".join(kept)


def build_shards(keys: DataFrame) -> DataFrame:
    """(shard, levels array<binary>, checks, counts, firsts, others binary) of keys (shard, h, check, n, first), each (h, check) once: the perfect hash, the arrays that it
    indexes, and rows (h, check, n, first) of keys whose h another key has."""

    def build(group: pa.Table) -> pa.Table:
        h, check, n, first = (group.column(c).to_numpy() for c in ("h", "check", "n", "first"))
        order = np.lexsort((check, h))
        again = np.zeros(len(h), bool)
        again[1:] = h[order][1:] == h[order][:-1]
        main, rest = order[~again], order[again]
        table = PerfectHash.of(h[main].view(np.uint64))
        at = table.index(h[main].view(np.uint64))
        arrays = []
        for values, kind in ((check, np.int32), (np.minimum(n, 255), np.uint8), (first, np.int64)):
            out = np.empty(table.size, kind)
            out[at] = values[main]
            arrays.append(out.tobytes())
        arrays.append(np.stack([x[rest].astype(np.int64) for x in (h, check, n, first)], 1).tobytes())
        return pa.table([group.column("shard").slice(0, 1), pa.array([table.packed()], pa.list_(pa.binary())), *(pa.array([x], pa.binary()) for x in arrays)], names=["shard", "levels", "checks", "counts", "firsts", "others"])

    return keys.groupBy("shard").applyInArrow(build, "shard long, levels array<binary>, checks binary, counts binary, firsts binary, others binary")


def probe(shards: DataFrame, probes: DataFrame) -> DataFrame:
    """Of probes (shard, copy, doc, row, h, check), those (doc, row, h, check) whose line is in several documents, and first in one with a smaller id."""

    def look_up(arrays: pa.Table, asked: pa.Table) -> pa.Table:
        if not arrays.num_rows or not asked.num_rows:
            return empty
        table = PerfectHash.unpacked(arrays.column("levels")[0].as_py())
        checks, counts, firsts, others = (np.frombuffer(arrays.column(c)[0].as_py(), kind) for c, kind in (("checks", np.int32), ("counts", np.uint8), ("firsts", np.int64), ("others", np.int64)))
        doc, h, check = (asked.column(c).to_numpy() for c in ("doc", "h", "check"))
        at = table.index(h.view(np.uint64))
        known = at >= 0
        at[~known] = 0
        drop = known & (checks[at] == check) & (counts[at] > 1) & (firsts[at] < doc)
        for key, own, n, first in others.reshape(-1, 4).tolist():
            here = (h == key) & (check == own)
            drop[here] = (n > 1) & (first < doc[here])
        return asked.select(["doc", "row", "h", "check"]).filter(pa.array(drop))

    kinds = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("h", pa.int64()), ("check", pa.int32())])
    empty = kinds.empty_table()
    return shards.groupBy("shard", "copy").cogroup(probes.groupBy("shard", "copy")).applyInArrow(look_up, "doc long, row long, h long, check int")


def repeated_lines(docs: DataFrame, least: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, row, hashes): the hashes (h, check) of the lines that each document's rows lose. doc is the id, LAST_ID for a null one; row is a hash of the text, so that
    the rows of one id, or without one, are apart."""
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID))
    text = text_or_empty(text_column)
    lines = docs.select(doc.alias("doc"), F.xxhash64(text).alias("row"), F.inline(_hashes(text, least)))
    lines = written(lines, "lines")
    # whether a line is in one document or in several is all that matters of its count
    keys = lines.groupBy("h", "check").agg(F.min("doc").alias("first"), F.when(F.min("doc") < F.max("doc"), 2).otherwise(1).alias("n"))
    keys = written(keys, "keys")
    shards = -(-keys.count() // SHARD_KEYS) or 1
    shard = lambda h: F.pmod(F.col(h), F.lit(shards)).alias("shard")
    probes = lines.select("doc", "row", "h", "check", shard("h"))
    # shards that are probed more often than a copy may be: a row for each SHARD_PROBES probes at most
    often = probes.groupBy("shard").count().filter(F.col("count") > SHARD_PROBES).select("shard", F.ceil(F.col("count") / F.lit(SHARD_PROBES)).cast("int").alias("copies"))
    often = written(often, "often")
    copied = lambda frame: frame.join(often, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    built = copied(build_shards(keys.select("h", "check", "first", "n", shard("h")))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    probes = copied(probes).withColumn("copy", F.pmod(F.xxhash64("doc", "row", "h"), F.col("copies")).cast("int")).drop("copies")
    return probe(built, probes).groupBy("doc", "row").agg(F.collect_set(F.struct("h", "check")).alias("hashes"))


def dedup_lines(docs: DataFrame, least: int = 10, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), out: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """Per row of docs: the id column, the columns of carry, n_lines long, n_dropped long, kept_text string; out are these three's names, which carry must not have.

    A text is split at line feeds; a null or empty one has one empty line. A line's key is the line without white space at its ends and with
    A-Z lower-cased. Keys of at least so many code points that are found in at least two documents keep their lines only in the document
    with the smallest id; all of that document's lines with the key stay. Rows with equal ids count as one document, and rows with null ids as
    one document after all others. Ids are integers. Other columns may have any names. An empty table gives no rows.
    """
    lost, row, hashes, text = spare(docs.columns, "doc", "row", "hashes", "whole_text")
    lines = repeated_lines(docs, least, id_column, text_column).toDF(lost, row, hashes)
    columns = [id_column, *(c for c in carry if c != id_column)]
    left = docs.select(*(F.col(f"`{c}`") for c in columns), text_or_empty(text_column).alias(text))
    joined = left.join(lines, (F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)) == F.col(lost)) & (F.xxhash64(text) == F.col(row)), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):  # bounds what is held at once
                part = batch.slice(first, 512)
                keys = part.column(part.num_columns - 1)
                at, flat = np.asarray(keys.offsets).tolist(), keys.values
                h, check = (flat.field(c).to_numpy() for c in ("h", "check"))
                found = []
                for i, whole in enumerate(part.column(part.num_columns - 2)):
                    whole = whole.as_py()
                    begin, end = at[i], at[i + 1]
                    if end > begin:
                        found.append(without(whole, set(zip(h[begin:end].tolist(), check[begin:end].tolist(), strict=True)), least))
                    else:
                        n = whole.count("\n") + 1
                        found.append((n, n, whole))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], pa.array([n for n, *_ in found], pa.int64()), pa.array([n - m for n, m, _ in found], pa.int64()), pa.array([x[2] for x in found], pa.string())], names=[*columns, *out],
                )

    asked = joined.select(*(F.col(f"`{c}`") for c in columns), text, hashes)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asked.schema.fields[: len(columns)])
    return asked.mapInArrow(strip, f"{kept}`{out[0]}` long, `{out[1]}` long, `{out[2]}` string")
