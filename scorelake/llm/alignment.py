"""Operator 11: cross-tokenizer alignment with id-striped dense count matrices.

Two tokenizers, side A (byte-level BPE) and side B (pieces), cut the same bytes, a space and the text. Byte offsets where tokens of both end cut them into groups, and each
token of A is linked with each of B in its group. How many documents hold a pair of ids linked is counted over all of them; each link then gets its pair's count, and whether that is the highest of its id of side A.

1. Documents are dealt to blocks of some megabytes. Texts are cut into units that no token of either side reaches over, and each distinct unit is tokenised and aligned once. A block keeps each document's distinct pairs as numbers, and lists its distinct pairs with how many of its documents hold each, by stripe: an id of A belongs to stripe id mod STRIPES,
   which spreads the frequent ids, whose numbers are low. This is written once; all that follows reads it.
2. Pairs are partitioned by stripe. Each stripe is a dense matrix (its ids of A by all ids of B, ROWS * 32,000 numbers for these files), into which the blocks' counts are added by np.add.at; the maxima of its rows are the best counts.
   Where there are many blocks, a stripe's are added in shares of about SHARE blocks first, so no task reads more than that many lists of one stripe.
3. Links, as the blocks' lists, are partitioned as the stripes are, each stripe ahead of its lists, so a task holds one matrix and streams the lists past it.
4. Counts go back to their blocks, where documents are summed up.

So a pair travels once for each block that has it, however many documents and places hold it; a hot id has as many list entries in a block as it has different partners there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scorelake.llm.byte_bpe import LONGEST_FAST, ByteBpe, _joined, _pack, _split, _unpack
from scorelake.llm.common import written
from scorelake.llm.piece_counts import MARK, PieceCounter

#: Bytes of text of a block, about; a longer text has a block of its own. Links of a block that are listed at a time.
BLOCK_BYTES, LINKS = 4 << 20, 4 << 20
#: Rows of a stripe's matrix, and blocks that are added in one task for each stripe.
ROWS, SHARE = 64, 4096
#: Groups with more links are listed by distinct ids.
LARGE = 64
#: Bytes of a number or sum that is written.
PLANES = 7
#: Characters of units that are tokenised together; no result depends on it.
CHUNK = 16_000


class Aligner:
    """Tokens of both sides and what follows from them, for the texts of a block.

    A text, with the space before it, is cut into units where tokens of neither side reach over: before a space or a line feed that follows a character which isn't white space, and
    behind a line feed between two such characters. Side A's pattern begins a word at these places, and side B's model has no piece over them, which is checked against its vocabulary. So groups don't
    reach over them either, and what a unit gives is found once in a block. A text with characters that versions of Unicode may class differently, or that side B changes, is one unit.
    """

    def __init__(self, a_path: str, b_path: str):
        counter = PieceCounter(b_path, frozenset())
        self.a, self.b, self.apart = ByteBpe(a_path), counter.model, counter.apart
        self.a.library.encode_special_tokens = True  # their strings are plain text
        model = self.b
        self.a_bytes = self.a.pieces
        self.b_bytes = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.get_piece_size())]
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_lengths, self.b_lengths = (np.array([len(p) for p in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.stripes = -(-self.n_a // ROWS)
        #: What each id adds to a text's groups: A's before a comma or a bar, B's before a comma or a semicolon.
        self.written = [b"%d%s" % (i, sep) for n, seps in ((self.n_a, (b",", b"|")), (self.n_b, (b",", b";"))) for i in range(n) for sep in seps]

    def units(self, text: str | None) -> list[str | tuple[str]]:
        """None for a null or empty text; a text that isn't cut stands in a tuple."""
        if not text:
            return []
        if not self.apart or MARK in text or "\0" in text or not text.isascii() and self.a.unsettled(text):
            return [(" " + text,)]
        return UNITS(" " + text)

    def tokens(self, unit: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both sides for a unit, and whether the bytes of each side are the unit's; if not, there are no ids."""
        if len(unit) <= LONGEST_FAST and self.a.ranked is not None and (unit.isascii() or not self.a.unsettled(unit)):
            a = np.frombuffer(self.a.ranked(unit, set()), np.uint32)
        else:
            a = np.frombuffer(self.a._plain(unit), np.uint32)
        # the library puts a space before a text; behind a line feed, nothing comes before a unit without one
        b = self.b.encode("\n")[:1] if unit == " " else self.b.encode(unit[1:]) if unit[0] == " " else self.b.encode("\n" + unit)[2:]
        b = np.array(b, np.uint32)
        data = unit.encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return NONE, NONE, False
        return a, b, True

    def sides(self, units: list[str | tuple[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of both sides of all units in turn, in parts: ids of A, ids of B, and for each unit where its ids of A and of B end. A unit whose bytes don't agree has none.

        Units that may follow each other in a text are tokenised together, as such a text; whole texts stand in tuples."""
        out, chunk, size = [], [], 0
        for u in units:
            if type(u) is str and len(u) <= CHUNK and not u[-1].isspace():
                chunk.append(u)
                size += len(u)
                if size < CHUNK:
                    continue
                u = None
            if chunk:
                out += self._together(chunk)
                chunk, size = [], 0
            if u is not None:
                out.append(self._alone(u if type(u) is str else u[0]))
        return out + (self._together(chunk) if chunk else [])

    def _alone(self, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b, _ = self.tokens(unit)
        return a, b, np.array([len(a)]), np.array([len(b)])

    def _together(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """A unit that begins with no white space stands behind a line feed in texts."""
        inner, asked = units, np.arange(len(units))
        bare = np.array([u[0] not in " \n" for u in units])
        if bare.any() or units[0][0] != " ":
            inner = [x for u, alone in zip(units, bare.tolist(), strict=True) for x in (("\n", u) if alone else (u,))]
            inner.insert(0, " a")
            asked = np.arange(1, len(units) + 1) + np.cumsum(bare)
        a, b, right = self.tokens("".join(inner))
        ends = np.cumsum(list(map(len, map(str.encode, inner))))
        cuts = []
        for ids, lengths in ((a, self.a_lengths), (b, self.b_lengths)):
            offsets = np.cumsum(lengths[ids])
            at = np.searchsorted(offsets, ends)
            right = right and len(offsets) and np.array_equal(offsets[np.minimum(at, len(offsets) - 1)], ends)
            cuts.append(np.concatenate([[0], at + 1]))
        if not right:
            return [self._alone(u) for u in units]
        out = []
        for ids, cut in zip((a, b), cuts, strict=True):
            n = np.diff(cut)[asked]
            upto = np.cumsum(n)
            out.append((ids[np.repeat(cut[asked] - (upto - n), n) + np.arange(int(upto[-1]))], upto))
        return [(out[0][0], out[1][0], out[0][1], out[1][1])]

    def described(self, units: list[str]) -> dict:
        """Per unit n_a, n_b, n_groups, n_links, whether bytes agree (right), its groups as text (parts) and how many distinct pairs it has (many); of all units in turn, the pairs' codes (a * n_b + b) and how many links each has."""
        found, n_units = self.sides(units), len(units)
        a, b = (np.concatenate([NONE, *(x[side] for x in found)]).astype(np.int64) for side in (0, 1))
        counts = [np.concatenate([np.zeros(0, np.int64), *(np.diff(x[side], prepend=0) for x in found)]) for side in (2, 3)]
        # both sides of a unit have as many bytes, so offsets run on over the units, and each one's end is common
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        marks = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.int8)
        marks[a_ends] = 1
        b_last = marks[b_ends].astype(np.int64)
        marks[a_ends] = 0
        marks[b_ends] = 1
        a_last = marks[a_ends].astype(np.int64)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n_groups = int(a_last.sum())
        a_of, b_of = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        a_upto, both_upto = np.cumsum(counts[0]), np.cumsum(counts[0] + counts[1])
        groups_upto = np.concatenate([[0], np.cumsum(a_last)])[a_upto]
        links_upto = np.concatenate([[0], np.cumsum(a_of * b_of)])[groups_upto]
        groups = np.diff(groups_upto, prepend=0)
        keys, links = self.pairs(a, b, a_group, b_group, a_of, b_of, np.repeat(np.arange(n_units), groups))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(b_of) - b_of)[a_group]] = 2 * a + a_last
        order[np.arange(len(b)) + np.cumsum(a_of)[b_group]] = 2 * (self.n_a + b) + b_last
        pieces, parts, at = list(map(self.written.__getitem__, order.tolist())), [], 0
        for to in both_upto.tolist():
            parts.append(b"".join(pieces[at:to]))
            at = to
        size = self.n_a * self.n_b
        return {"n_a": counts[0], "n_b": counts[1], "n_groups": groups, "n_links": np.diff(links_upto, prepend=0), "right": counts[0] > 0, "parts": parts, "many": np.bincount(keys // size, minlength=n_units), "codes": keys % size, "links": links}

    def block(self, texts: list[str | None]) -> dict:
        """Per text n_a, n_b, n_groups, n_links, groups_sha256 and how many distinct pairs (distinct); of all texts in turn each distinct pair's number and how many links it is (links);
        and the block's pairs, by stripe and cell, with how many texts hold each (docs)."""
        number = _Numbers()
        rows = [list(map(number.__getitem__, self.units(t))) for t in texts]
        facts = self.described(list(number))
        wrong = set(np.flatnonzero(~facts["right"]).tolist())
        if wrong:
            rows = [[] if wrong.intersection(r) else r for r in rows]
        parts = facts["parts"]
        shas = [hashlib.sha256(b"".join(map(parts.__getitem__, r))[:-1]).hexdigest() if r else "" for r in rows]
        sizes = np.array([len(r) for r in rows], np.int64)
        unit = np.concatenate([np.zeros(0, np.int64), *(np.array(r, np.int64) for r in rows)])
        upto = np.cumsum(sizes)
        out = {c: np.diff(np.concatenate([[0], np.cumsum(facts[c][unit])])[upto], prepend=0) for c in PER_DOC}
        codes, own = np.unique(facts["codes"], return_inverse=True)
        stripe, cell = self.place(codes)
        order = np.lexsort((cell, stripe))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = rank[own]
        # each text's distinct units, then their pairs
        n_units, n_pairs = max(1, len(parts)), max(1, len(codes))
        held, times = np.unique(np.repeat(np.arange(len(rows)), sizes) * n_units + unit, return_counts=True)
        doc, unit = held // n_units, held % n_units
        many = facts["many"]
        starts, found = np.cumsum(many) - many, []
        for at, to in _slices(np.cumsum(many[unit]), LINKS):
            n = many[unit[at:to]]
            ends = np.cumsum(n)
            pair = np.repeat(starts[unit[at:to]] - (ends - n), n) + np.arange(int(ends[-1]))
            found.append(_summed(np.repeat(doc[at:to], n) * n_pairs + own[pair], np.repeat(times[at:to], n) * facts["links"][pair]))
        keys, links = _merged(found)
        number = keys % n_pairs
        held_by = np.bincount(number, minlength=len(codes))
        return out | {
            "groups_sha256": shas, "distinct": np.bincount(keys // n_pairs, minlength=len(rows)), "number": number, "links": links,
            "stripe": stripe[order], "cell": cell[order], "docs": held_by,
        }

    def place(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stripe of each pair, and its cell there."""
        a, b = codes // self.n_b, codes % self.n_b
        return a % self.stripes, a // self.stripes * self.n_b + b

    def pairs(self, a, b, a_group, b_group, a_of, b_of, item_of_group) -> tuple[np.ndarray, np.ndarray]:
        """Each item's distinct pairs (item * n_a * n_b + code, rising) and how many links each has."""
        found, size = [], self.n_a * self.n_b
        large = a_of * b_of > LARGE
        starts = np.cumsum(b_of) - b_of
        own = np.flatnonzero(~large[a_group])  # tokens of A in other groups, one after the other
        many = b_of[a_group[own]]
        for at, to in _slices(np.cumsum(many), LINKS):
            rows, n = own[at:to], many[at:to]
            group = a_group[rows]
            ends = np.cumsum(n)
            partner = np.repeat(starts[group] - (ends - n), n) + np.arange(int(ends[-1]))
            found.append(_summed(np.repeat(item_of_group[group] * size + a[rows] * self.n_b, n) + b[partner]))
        if large.any():
            (ga, ia, ca), (gb, ib, cb) = (_distinct(g[large[g]], i[large[g]], n) for g, i, n in ((a_group, a, self.n_a), (b_group, b, self.n_b)))
            many_b = np.bincount(gb, minlength=len(large))
            first, n = (np.cumsum(many_b) - many_b)[ga], many_b[ga]
            for at, to in _slices(np.cumsum(n), LINKS):
                ends = np.cumsum(n[at:to])
                partner = np.repeat(first[at:to] - (ends - n[at:to]), n[at:to]) + np.arange(int(ends[-1]))
                found.append(_summed(np.repeat(item_of_group[ga[at:to]] * size + ia[at:to] * self.n_b, n[at:to]) + ib[partner], np.repeat(ca[at:to], n[at:to]) * cb[partner]))
                found = [_merged(found)]
        return _merged(found)


class _Numbers(dict):
    """Numbers of different keys, in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


PER_DOC = ["n_a", "n_b", "n_groups", "n_links"]
NONE = np.zeros(0, np.uint32)
#: A line feed between characters that aren't white space; white space and what follows, up to a space or line feed behind such a character; white space at the end.
UNITS = re.compile(r"\n(?=\S)|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+\Z").findall


def _slices(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into slices of about most in sum; upto has the sums up to each row."""
    at = 0
    while at < len(upto):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _summed(keys: np.ndarray, links: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their links (one each, if not told)."""
    if links is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(links[order], first) if len(first) else links[:0]


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    return _summed(*(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1)))


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, times = np.unique(group * size + ids, return_counts=True)
    return keys // size, keys % size, times


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker and pair of files."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(a_path, b_path)


def blocks(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each block a row without stripe: its rows' ids, PER_DOC, groups_sha256, how many distinct pairs each has and (links) their numbers and how many links they are; and
    for each of its stripes a row (stripe, block, first, cells, docs) with its pairs, numbered from first on."""
    kind = docs.select(F.col(id_column)).schema[0].dataType
    schema = f"block long, stripe int, first int, cells array<int>, docs array<int>, ids array<{kind.simpleString()}>, " + "".join(f"{c} array<long>, " for c in [*PER_DOC, "distinct"]) + "groups_sha256 array<string>, links binary"
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, made = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def lists(values: np.ndarray, starts: np.ndarray, element: pa.DataType) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, element))

        def block() -> Iterator[pa.RecordBatch]:
            own, found = (task << 32) + made, both.block(texts)
            texts.clear()
            columns = {c: lists(found[c], [0, len(found[c])], pa.int64()) for c in [*PER_DOC, "distinct"]}
            held = pa.concat_arrays(ids)
            columns |= {"block": pa.array([own]), "ids": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), "groups_sha256": lists(found["groups_sha256"], [0, len(held)], pa.string()), "links": pa.array([packed(found["number"], found["links"])], pa.binary())}
            yield filled(columns, 1)
            stripes, first = np.unique(found["stripe"], return_index=True)
            if len(stripes):
                starts = np.append(first, len(found["cell"]))
                yield filled({"block": pa.array([own] * len(stripes)), "stripe": pa.array(stripes, pa.int32()), "first": pa.array(first, pa.int32()), "cells": lists(found["cell"], starts, pa.int32()), "docs": lists(found["docs"], starts, pa.int32())}, len(stripes))

        def filled(columns: dict, n: int) -> pa.RecordBatch:
            types = {"block": pa.int64(), "stripe": pa.int32(), "first": pa.int32(), "cells": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()), "ids": pa.list_(to_arrow_type(kind)), "groups_sha256": pa.list_(pa.string()), "links": pa.binary()}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types.get(c, pa.list_(pa.int64()))) for c in names], names=names)

        for batch in batches:
            column, since = batch.column(0), 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    ids.append(column.slice(since, i + 1 - since))
                    yield from block()
                    made, since, size = made + 1, i + 1, 0
                    ids.clear()
                    pa.default_memory_pool().release_unused()
            if since < batch.num_rows:
                ids.append(column.slice(since))
        if texts:
            yield from block()

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def packed(numbers: np.ndarray, links: np.ndarray) -> bytes:
    """Pairs' numbers and how many links each is, by planes of bytes."""
    return _joined(*(_pack((x >> (8 * i) & 255).astype(np.uint8).tobytes()) for x in (numbers, links) for i in range(PLANES)))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = [np.frombuffer(_unpack(p), np.uint8) for p in _split(data)]
    whole = lambda own: sum(p.astype(np.int64) << (8 * i) for i, p in enumerate(own) if p.any()) + np.zeros(len(own[0]), np.int64)
    return whole(planes[:PLANES]), whole(planes[PLANES:])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and where each row's start and end."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values), bounds


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Rows that agree in all columns and follow each other."""
    n = len(columns[0])
    changed = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if n else []


def _added(pairs: DataFrame, keys: list[str], cells: int, out: str) -> DataFrame:
    """(stripe, cells, docs) with the counts of all rows of a key added up in one dense matrix, for rows that are partitioned and sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, current = None, None

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(matrix)
            bounds = pa.array([0, len(at)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(matrix[at], pa.int64()))], names=["stripe", "cells", out])

        for batch in batches:
            values, bounds = _lists(batch.column("cells"))
            counts, _ = _lists(batch.column("docs"))
            columns = [np.asarray(batch.column(k)) for k in keys]
            for first, to in _runs(*columns):
                key = tuple(int(c[first]) for c in columns)
                if key != current:
                    if current is not None:
                        yield told()
                    matrix, current = np.zeros(cells, np.int64), key
                span = slice(bounds[first], bounds[to])
                np.add.at(matrix, values[span], counts[span])
        if current is not None:
            yield told()

    return pairs.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "cells", "docs").mapInArrow(run, f"stripe int, cells array<int>, {out} array<long>")


def pair_counts(pairs: DataFrame, shares: int, cells: int) -> DataFrame:
    """(stripe, cells, counts): how many documents hold each pair of a stripe. First by shares of blocks, then over all of them."""
    by_share = _added(pairs.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares))), ["stripe", "share"], cells, "docs")
    return _added(by_share, ["stripe"], cells, "counts")


def _scored(pairs: DataFrame, counts: DataFrame, shares: int, rows: int, n_b: int) -> DataFrame:
    """(block, first, counts, best) for each list of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = best = None
        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            values, bounds = _lists(batch.column("cells"))
            held, held_bounds = _lists(batch.column("counts"))
            found, sizes, asked = [], [], np.flatnonzero(kinds == 1)
            for first, to in _runs(kinds, np.asarray(batch.column("stripe")), np.asarray(batch.column("share"))):
                span = slice(bounds[first], bounds[to])
                if kinds[first] == 0:  # one row: the stripe itself, ahead of its lists
                    matrix = np.zeros(rows * n_b, np.int64)
                    matrix[values[span]] = held[held_bounds[first] : held_bounds[to]]
                    best = matrix.reshape(rows, n_b).max(axis=1)
                else:
                    own = matrix[values[span]]
                    found.append((own, own == best[values[span] // n_b]))
                    sizes.append(np.diff(bounds[first : to + 1]))
            if found:
                starts = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x))) for x in zip(*found, strict=True)]
                take = pa.array(asked)
                yield pa.RecordBatch.from_arrays([batch.column("block").take(take), batch.column("first").take(take), *lists], names=["block", "first", "counts", "best"])

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
    stripes = counts.select("stripe", every.alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("first"), "cells", "counts")
    asked = pairs.select("stripe", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("long").alias("share"), F.lit(1).alias("kind"), "block", "first", "cells", F.lit(None).cast("array<bigint>").alias("counts"))
    dealt = stripes.union(asked).repartition("stripe", "share").sortWithinPartitions("stripe", "share", "kind")
    return dealt.mapInArrow(run, "block long, first int, counts array<long>, best array<boolean>")


def _stored(docs: DataFrame, a_path: str, b_path: str, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, int]:
    """Blocks and their lists of pairs, from one stored table, and how many shares."""
    made = written(blocks(docs, a_path, b_path, id_column, text_column), "blocks")
    whole = made.filter("stripe IS NULL").drop("stripe", "first", "cells", "docs")
    return whole, made.filter("stripe IS NOT NULL").select("stripe", "block", "first", "cells", "docs"), max(1, -(-whole.count() // SHARE))


def partners(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(a int, b int, n_docs long, best boolean): each linked pair of ids, how many rows of docs hold it, and whether no other partner of a has more. Odd rows: see align."""
    both = aligner(a_path, b_path)
    _, pairs, shares = _stored(docs, a_path, b_path, id_column, text_column)
    each = pair_counts(pairs, shares, ROWS * both.n_b).select("stripe", F.explode(F.arrays_zip("cells", "counts")).alias("x"))
    a = (F.expr(f"x.cells DIV {both.n_b}") * both.stripes + F.col("stripe")).cast("int")
    told = each.select(a.alias("a"), (F.col("x.cells") % both.n_b).alias("b"), F.col("x.counts").alias("n_docs"))
    top = told.groupBy("a").agg(F.max("n_docs").alias("most"))
    return told.join(top, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: the id column, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256 string.

    A null or empty text, and one whose tokens' bytes on either side aren't a space and the text, has no tokens: zeros and an empty string. Each row counts as a document, whatever its id;
    repeated rows give repeated results. Other columns are ignored; an empty table gives no rows. Memory holds one block, or one text where that is longer.
    """
    both = aligner(a_path, b_path)
    whole, pairs, shares = _stored(docs, a_path, b_path, id_column, text_column)
    n_b = both.n_b
    scored = _scored(pairs, pair_counts(pairs, shares, ROWS * n_b), shares, ROWS, n_b)
    kind = docs.select(F.col(id_column)).schema[0].dataType
    names = [id_column, *PER_DOC, "n_best", "count_sum", "groups_sha256"]

    def summed(block: pa.Table, found: pa.Table) -> pa.Table:
        """One row of a block, and the scores of its lists."""
        one = lambda c: block.column(c).chunk(0).values
        order = np.argsort(np.asarray(found.column("first")))
        lists = found.take(pa.array(order))
        flat = lambda c, t: np.asarray(lists.column(c).combine_chunks().flatten()).astype(t)
        counts, best = flat("counts", np.int64), flat("best", np.int64)
        number, links = unpacked(block.column("links")[0].as_py())
        upto = np.cumsum(np.asarray(one("distinct")))
        sums = [np.diff(np.concatenate([[0], np.cumsum(links * x[number])])[upto], prepend=0) for x in (best, counts)]
        return pa.table([one("ids"), *(one(c) for c in PER_DOC), *(pa.array(s, pa.int64()) for s in sums), one("groups_sha256")], names=names)

    schema = f"`{id_column}` {kind.simpleString()}, " + "".join(f"{c} long, " for c in names[1:-1]) + "groups_sha256 string"
    return whole.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(summed, schema)
