"""Operator 5: near-duplicate groups by b-bit MinHash.

1. Each text becomes a set of hashed word shingles; of its 128 minima, bands of four make its bucket keys, and four low bits of each are packed into
   a signature of 64 bytes. Texts with equal sets collapse to the one with the smallest id.
2. Each bucket's members are candidates of its smallest member. The share of equal low bits, corrected for those equal by chance, estimates the
   similarity. A text's root is the smallest of its leaders whose estimate isn't MARGIN standard errors below the threshold. Links
   with roots are confirmed on full sets, and the difference of both sets is kept: for two texts a and b of one root r,
   a xor b = (a xor r) xor (b xor r), so the small differences alone give their exact similarity. A root that has a root of its own hands its
   members on, with the differences combined.
3. Members of a root that aren't in its component are compared with all its members, exactly, within the task; it gives out only links that join
   what was apart. No pairs leave it, so a group of n near copies costs about n links and not n * n.
4. Where a bucket still spans several components, members of different roots are compared by bit counts. Those that have a partner which the
   counts can't rule out bring their full sets along, and are compared exactly, again within the task and with joining links alone given out.

Large groups are compared in pairs of blocks, each a group of its own. Nothing is sampled or capped. A pair of similarity 0.8 shares no
bucket with a probability of 5e-8, one of 0.85 with 6e-11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import written
from scorelake.llm.components import components, extended

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
#: Standard errors of the estimate below the threshold from which a candidate is left out.
MARGIN = 5.5
#: Members of a bucket that are compared in one group, twice this many for a pair of blocks.
BLOCK = 4096
#: Shingles that the full sets of a block have together, about.
BLOCK_SHINGLES = 1 << 20
#: Bytes hashed at a time, and of a word from which it is hashed on its own.
STEP, LONG_WORD = 1 << 18, 4096
LAST_ID = (1 << 63) - 1
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER += np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_UP, _DOWN = _powers(_BASE, STEP), _powers(pow(_BASE, -1, 1 << 64), STEP)
_draw = np.random.default_rng(20240229)
_FACTORS = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of at most STEP bytes: prefix sums of a polynomial give every word's in a few passes."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LOWER[data] * _UP[: len(data)], dtype=np.uint64)])
    out = mixed((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(end - start >= LONG_WORD):
        out[i] = _hash_long(data[start[i] : end[i]].tobytes())
    return out


def _hash_long(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower())


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= STEP:
        return _hash_words(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + STEP, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a step
                while end < len(data) and not _SPACE[data[end]]:
                    more = np.flatnonzero(_SPACE[data[end : end + STEP]])
                    end += int(more[0]) if len(more) else min(STEP, len(data) - end)
                out.append(np.array([_hash_long(data[at:end].tobytes())], np.uint64))
                at = end
                continue
        out.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted: of so many words, or of all if there are fewer; none without words."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = mixed(out * np.uint64(0x165667B19E3779F9) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def minima(values: np.ndarray) -> np.ndarray:
    small = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), 512):
        np.minimum(out, (small[at : at + 512, None] * _FACTORS + _OFFSETS).min(0), out=out)
    return out


def sketch(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bucket keys and the packed low bits of the minima."""
    m = minima(values)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * np.uint64(0x165667B19E3779F9) + m[i::ROWS].astype(np.uint64))
    low = ((m * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return keys.view(np.int64), (low[::2] << 4 | low[1::2]).tobytes()


def _digest(values: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64)


def equal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed signatures (..., 8 words), how many of the HASHES groups of bits are equal."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return HASHES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal groups, less those equal by chance."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    p = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def _ids(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def sketches(docs: DataFrame, words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, n_shingles, s1, s2 (a digest of the set), bands array<long>, bits binary) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                n, s1, s2, bands, bits = [], [], [], [], []
                for text in part.column(1):
                    values = shingles(text.as_py(), words)
                    keys, packed = sketch(values) if len(values) else (np.zeros(0, np.int64), b"")
                    digest = _digest(values)
                    n.append(len(values))
                    s1.append(int(digest[0]))
                    s2.append(int(digest[1]))
                    bands.append(keys)
                    bits.append(packed)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
                band_column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), band_column, pa.array(bits, pa.binary())], names=names)

    names = ["doc", "n_shingles", "s1", "s2", "bands", "bits"]
    return docs.select(_ids(id_column).alias("doc"), F.col(text_column).alias("text")).mapInArrow(run, "doc long, n_shingles long, s1 long, s2 long, bands array<long>, bits binary")


def deltas(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked, n_a, n_b, delta) for pairs (a, b): as confirmed, with the sizes of both sets and the shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                linked, sizes, out = [], [], []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    p, q = shingles(x.as_py(), words), shingles(y.as_py(), words)
                    delta = np.setxor1d(p, q, assume_unique=True)
                    either = (len(p) + len(q) + len(delta)) // 2
                    linked.append(either > len(delta) and 100 * (either - len(delta)) >= percent * either)
                    sizes.append((len(p), len(q)))
                    out.append(delta.view(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array([n for n, _ in sizes], pa.int64()), pa.array([n for _, n in sizes], pa.int64()), column], names=["a", "b", "linked", "n_a", "n_b", "delta"])

    one = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean, n_a long, n_b long, delta array<long>")


def exact_links(rows: pa.Table, cols: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between rows and cols (doc, component, n, delta from one root) of different components, exact; only such as join what no earlier one has joined."""
    part = lambda t, c: t.column(c).to_numpy()
    lists = [t.column("delta").combine_chunks() for t in (rows, cols)]
    values = np.asarray(lists[1].flatten())
    lengths = np.diff(np.asarray(lists[1].offsets))
    holder = np.repeat(np.arange(cols.num_rows), lengths)
    order = np.argsort(values, kind="stable")
    values, holder = values[order], holder[order]
    doc, component, n = part(cols, "doc"), part(cols, "component"), part(cols, "n")
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    offsets, flat = np.asarray(lists[0].offsets), np.asarray(lists[0].values)
    for own, label, size, begin, end in zip(part(rows, "doc").tolist(), part(rows, "component").tolist(), part(rows, "n").tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        delta = flat[begin:end]
        at, to = np.searchsorted(values, delta, "left"), np.searchsorted(values, delta, "right")
        hits = [holder[x:y] for x, y in zip(at.tolist(), to.tolist(), strict=True) if y > x]
        shared = np.bincount(np.concatenate(hits), minlength=len(doc)) if hits else 0
        apart = len(delta) + lengths - 2 * shared
        both = (size + n - apart) // 2
        found = np.flatnonzero((both > 0) & (100 * both >= percent * (size + n - both)) & (component != label))
        for label_2, first in zip(*np.unique(component[found], return_index=True), strict=True):
            p, q = find(label), find(int(label_2))
            if p != q:
                parent[p] = q
                links.append((own, int(doc[found[first]])))
    return links


def _within_roots(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members (root, doc, n, delta, component) of one root, where they aren't all of the root's component."""
    counts = members.groupBy("root", "component").agg(F.count("*").alias("n"), F.max(F.col("doc") == F.col("root")).alias("own"))
    counts = counts.groupBy("root").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("own"), F.col("n"))).alias("n_own"), F.max(F.when(F.col("own"), F.col("component"))).alias("own"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    # a table of its own, of the roots that matter: a join with it can be split, whatever one root has for members
    sizes = written(counts.filter("n > n_own").select("root", "own", blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("n_own")).alias("minor_blocks")), "roots")
    dealt = members.join(sizes, "root").withColumn("minor", F.col("component") != F.col("own"))
    own = lambda blocks: F.pmod(F.xxhash64("doc"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    kept = ["root", "i", "j", "side", "doc", "component", "n", "delta"]
    rows = dealt.filter("minor").withColumns({"side": F.lit(0), "i": own("minor_blocks")}).withColumn("j", each("all_blocks")).select(*kept)
    cols = dealt.withColumns({"side": F.lit(1), "j": own("all_blocks")}).withColumn("i", each("minor_blocks")).select(*kept)

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        links = exact_links(*(group.filter(pa.array(side == s)) for s in (0, 1)), percent) if 0 < side.sum() < len(side) else []
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return rows.union(cols).groupBy("root", "i", "j").applyInArrow(compare, "a long, b long")


def _rebased(rooted: DataFrame) -> DataFrame:
    """(root, doc, n, delta) of rooted, each from the smallest root that its chain of roots leads to: differences along a chain combine by exclusive or.
    A text whose difference would be larger than itself keeps the root before. Roots get smaller with each step, so this ends."""
    based = rooted.select(F.col("a").alias("root"), F.col("b").alias("doc"), F.col("n_b").alias("n"), "delta")
    while True:
        up = based.select(F.col("doc").alias("root"), F.col("root").alias("next_root"), F.col("delta").alias("next_delta"))
        both = F.concat(F.array_except("delta", "next_delta"), F.array_except("next_delta", "delta"))
        joined = based.join(up, "root", "left").withColumn("both", F.when(F.col("next_root").isNotNull(), both))
        moves = F.coalesce(F.size("both") < F.col("n"), F.lit(False))
        step = joined.select(F.when(moves, F.col("next_root")).otherwise(F.col("root")).alias("root"), "doc", "n", F.when(moves, F.col("both")).otherwise(F.col("delta")).alias("delta"), moves.alias("moved"))
        step = written(step, "based")
        based = step.drop("moved")
        if step.filter("moved").isEmpty():
            return based


def _blocks(members: DataFrame, blocks: DataFrame, columns: list[str]) -> DataFrame:
    """members (bucket, doc and columns) of the buckets of blocks (bucket, blocks), dealt to pairs of blocks: bucket, i, j, block, doc and columns."""
    rows = members.join(blocks, "bucket")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", *columns)


def alike(group: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a group (i, j, block, doc, root, component, bits), as two arrays of equal length, that are of different components and roots and whose estimate is at least
    least: each pair of block i and block j once."""
    doc, root, component, block = (group.column(c).to_numpy() for c in ("doc", "root", "component", "block"))
    bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(doc), -1)
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    labels, code = np.unique(component, return_inverse=True)
    if len(labels) == 1:
        return
    # within the largest component there is nothing to find: one of each pair is of another
    major = code == np.bincount(code).argmax()
    rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sides = [(rows[~major[rows]], cols)] + ([(rows[major[rows]], cols[~major[cols]])] if i != j else [])
    for left, right in sides:
        for at in range(0, len(left), 128):  # bounds what a comparison holds at once
            here = left[at : at + 128]
            for to in range(0, len(right), 1024):
                there = right[to : to + 1024]
                good = (component[here][:, None] != component[there][None, :]) & (estimate(equal_bits(bits[here][:, None, :], bits[there][None, :, :])) >= least)
                good &= (root[here][:, None] != root[there][None, :]) & (doc[here][:, None] != root[there][None, :]) & (root[here][:, None] != doc[there][None, :])
                x, y = np.nonzero(good)
                x, y = here[x], there[y]
                once = (major[y] | (x < y)) if i == j else slice(None)
                yield x[once], y[once]


def _across(members: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float, percent: int) -> DataFrame:
    """(a, b): links of members (bucket, doc, root, component, bits) of one bucket but different components and roots. sets gives (doc, shingles array<long>) for (doc)."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2")
    sizes = written(sizes.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")

    def likely(group: pa.Table) -> pa.Table:
        active = np.zeros(group.num_rows, bool)
        for x, y in alike(group, least):
            active[x] = active[y] = True
        return group.filter(pa.array(active)).select(["bucket", "doc", "root", "component", "bits"])

    few = ["root", "component", "bits"]
    kinds = "bucket long, doc long, root long, component long, bits binary"
    active = _blocks(members, sizes, few).groupBy("bucket", "i", "j").applyInArrow(likely, kinds)
    active = written(active.dropDuplicates(["bucket", "doc"]), "active")
    if active.isEmpty():
        return active.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    full = written(sets(active.select("doc").distinct()), "sets")
    with_sizes = active.join(full.select("doc", F.size("shingles").alias("n")), "doc")
    # buckets with the same members do the same work: one of each stays
    facts = with_sizes.groupBy("bucket").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("all_docs"))
    facts = facts.groupBy("n_docs", "n", "all_docs").agg(F.min("bucket").alias("bucket"))
    blocks = written(facts.select("bucket", F.least(F.col("n_docs"), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "blocks")

    def compare(group: pa.Table) -> pa.Table:
        doc, component = group.column("doc").to_numpy(), group.column("component").to_numpy()
        lists = group.column("shingles").combine_chunks()
        flat, at = np.asarray(lists.values), np.asarray(lists.offsets)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        links = []
        for xs, ys in alike(group, least):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                p, q = find(int(component[x])), find(int(component[y]))
                if p == q:
                    continue
                one, two = flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both and 100 * both >= percent * (len(one) + len(two) - both):
                    parent[p] = q
                    links.append((int(doc[x]), int(doc[y])))
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    dealt = _blocks(active, blocks, few).join(full, "doc")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _nodes(all_rows: DataFrame, repeated: bool) -> DataFrame:
    """(s1, s2, node, doc, shared, bands, bits): one row for each distinct set. Its node is the smallest id that has it; where rows repeat an id with several sets
    (shared), all but one have a hash as their node."""
    sets = all_rows.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    if not repeated:
        return sets.select("s1", "s2", F.col("doc").alias("node"), "doc", F.lit(False).alias("shared"), "bands", "bits")
    of_id = sets.groupBy("doc").agg(F.min(F.struct("s1", "s2")).alias("first"), (F.count("*") > 1).alias("shared"))
    ranked = sets.join(of_id, "doc")
    return ranked.select("s1", "s2", F.when(F.struct("s1", "s2") == F.col("first"), F.col("doc")).otherwise(F.xxhash64("s1", "s2")).alias("node"), "doc", "shared", "bands", "bits")


def _texts(docs: DataFrame, nodes: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(doc, text) for nodes (node, doc, shared, s1, s2): doc is the node. A repeated id's texts are told apart by their sets; one row for each node and repeated row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, text, shared, s1, s2 = batch.columns
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(np.asarray(shared)):
                digest = _digest(shingles(text[i].as_py(), words))
                keep[i] = (int(digest[0]), int(digest[1])) == (s1[i].as_py(), s2[i].as_py())
            yield pa.RecordBatch.from_arrays([node, text], names=["doc", "text"]).filter(pa.array(keep))

    rows = docs.select(_ids(id_column).alias("doc"), F.col(text_column).alias("text")).join(nodes, "doc")
    return rows.select("node", "text", "shared", "s1", "s2").mapInArrow(run, "doc long, text string")


def _shingle_lists(texts: DataFrame, words: int) -> DataFrame:
    """(doc, shingles array<long>) of texts (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = [shingles(x.as_py(), words).view(np.int64) for x in part.column(1)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists)))], names=["doc", "shingles"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, shingles array<long>")


def groups(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, n_shingles, component) for each row of docs; ids as longs, LAST_ID for a null one."""
    least = least_estimate(percent / 100)
    all_rows = written(sketches(docs, words, id_column, text_column), "sketches")
    repeated = not all_rows.groupBy("doc").count().filter("count > 1").isEmpty()
    nodes = written(_nodes(all_rows, repeated), "nodes")
    keyed = nodes.select(F.col("node").alias("doc"), F.posexplode("bands").alias("band", "key")).select("doc", F.xxhash64("band", "key").alias("bucket"))
    # a table of its own, so that the join with it can be split where a bucket is very large
    leaders = written(keyed.groupBy("bucket").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("bucket", "leader"), "leaders")
    members = written(keyed.join(leaders, "bucket"), "members")
    bits = nodes.select(F.col("node").alias("doc"), "bits")
    candidates = members.filter("doc <> leader").select("doc", "leader").distinct()
    rated = candidates.join(bits.withColumnRenamed("bits", "own"), "doc").join(bits.select(F.col("doc").alias("leader"), F.col("bits").alias("other")), "leader")
    rated = rated.mapInArrow(_rate, "doc long, leader long, est double").filter(F.col("est") >= least)
    first = written(rated.groupBy("doc").agg(F.min("leader").alias("a")).select("a", F.col("doc").alias("b")), "first")
    needed = nodes.select("node", "doc", "shared", "s1", "s2").join(members.select(F.col("doc").alias("node")).distinct(), "node", "left_semi")
    texts = written(_texts(docs, needed, words, id_column, text_column), "texts")
    if repeated:
        texts = written(texts.groupBy("doc").agg(F.min("text").alias("text")), "texts")  # rows with equal sets
    rooted = written(deltas(first, texts, words, percent), "rooted")
    edges = rooted.filter("linked").select("a", "b")
    if repeated:  # rows with equal ids are one document
        of_row = all_rows.filter("n_shingles > 0").select("s1", "s2", F.col("doc").alias("own")).join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
        several = written(of_row.groupBy("own").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").select("own", "a"), "several")
        edges = edges.union(of_row.join(several, "own").select("a", F.col("node").alias("b")).filter("a <> b").distinct())
    labels = written(components(edges), "labels")
    none = F.array().cast("array<long>")
    of_roots = _rebased(rooted)
    roots = rooted.groupBy("a").agg(F.min("n_a").alias("n")).select(F.col("a").alias("root"), F.col("a").alias("doc"), "n", none.alias("delta"))
    labels = extended(labels, _within_roots(_labelled(of_roots.union(roots), labels), percent))
    own_roots = of_roots.select("doc", "root")
    known = bits.join(own_roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    open_members = _labelled(members.select("bucket", "doc"), labels).join(known, "doc")
    sets = lambda asked: _shingle_lists(texts.join(asked, "doc"), words)
    labels = extended(labels, _across(open_members, sets, least, percent))
    of_set = _labelled(nodes.select("s1", "s2", F.col("node").alias("doc"), F.col("doc").alias("least")), labels)
    if repeated:  # a node may be a hash
        smallest = written(of_set.groupBy("component").agg(F.min("least").alias("first_id")), "smallest")
        of_set = of_set.join(smallest, "component").select("s1", "s2", F.col("first_id").alias("component"))
    joined = all_rows.select("doc", "n_shingles", "s1", "s2").join(of_set.select("s1", "s2", "component"), ["s1", "s2"], "left")
    return joined.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, HASHES * BITS // 64) for c in ("own", "other"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("leader"), pa.array(estimate(equal_bits(own, other)))], names=["doc", "leader", "est"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles long, component_id, kept boolean (the id is the component's smallest).

    Two texts are linked when 100 * intersection >= percent * union of their sets of distinct shingles of so many words (A-Z lower-cased,
    words between ASCII white space; a text with fewer words is one shingle). A text without words, or null, has an empty set and is
    linked with nothing. Rows that repeat an id are one document, which has the links of all of them; so are rows with a null id,
    which comes after all others. An empty table gives no rows; other columns may have any names.
    """
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    found = groups(docs, words, percent, id_column, text_column)
    return found.select(real("doc").alias(id_column), "n_shingles", real("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
