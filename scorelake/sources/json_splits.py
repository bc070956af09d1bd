"""Elements of large JSON files, read by many tasks.

A file with one list or object is no line format, yet it can be split: Spark's text source, with a comma as the end of a line, gives each task the records that begin in its
byte range, on any file system that Spark reads. What a task can't know is whether its range begins within a string, and how deep. Both follow from sums over the ranges before it:

1. Each range counts its quotes, and how much deeper it ends if it begins outside a string, and if within one. Sums of these over a file's ranges, one row for each range, tell how each begins.
2. With that known, each range tells which containers it opens and how many elements begin there. Sums of these number the elements.
3. Each range gives its elements' texts. One that reaches over ranges comes in parts, and only parts are shuffled.

The rows of steps 1 and 2, one for each range, come to the driver, as the ranges themselves have. A range that is read again, by another executor, gives the same rows. Memory holds a batch and one element.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
STEP = np.zeros(256, np.int64)
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
MARKS = np.zeros(256, bool)
MARKS[[QUOTE, BACKSLASH, COMMA, *b"[]{}"]] = True
#: The string before a colon that ends a text.
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
BLANK = b" \t\r\n\xef\xbb\xbf"


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where brackets, commas and quotes stand that no backslash escapes, their bytes, and whether the quotes up to each are odd. Records end behind a comma, so no escape reaches over them."""
    letters = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(MARKS[letters])
    kinds = letters[at]
    slashes = at[kinds == BACKSLASH]
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        ends = slashes[np.append(first[1:], len(slashes)) - 1] + 1
        odd = (ends - slashes[first]) % 2 == 1
        kept = (kinds != BACKSLASH) & ~np.isin(at, ends[odd])
        at, kinds = at[kept], kinds[kept]
    return at, kinds, np.cumsum(kinds == QUOTE) % 2 == 1


def _records(spark: SparkSession, path: str) -> DataFrame:
    # a byte range is a file's block of the scan; rows of one come in order
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, bytes) of successive parts of ranges, with the commas."""
    for batch in batches:
        files, starts = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
        codes, values = np.asarray(files.indices), batch.column(2)
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            yield files.dictionary[int(codes[at])].as_py(), int(starts[at]), b",".join(values.slice(at, to - at).to_pylist()) + b","


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, odd, out_step, in_step, top): whether a range has an odd number of quotes, how much deeper it ends if it begins outside or inside a string, and a file's first character."""
    found: dict[tuple[str, int], list] = {}
    for file, start, data in _ranges(batches):
        _, kinds, odd = _marks(data)
        held = found.setdefault((file, start), [False, 0, 0, ""])
        steps = STEP[kinds]
        inside = odd ^ held[0]
        # quotes step nowhere, so they don't matter here
        held[1] += int(steps[~inside].sum())
        held[2] += int(steps[inside].sum())
        held[0] ^= bool(len(odd) and odd[-1])
        if not held[3]:
            held[3] = data.lstrip(BLANK)[:1].decode("latin-1")
    rows = [(*k, *v) for k, v in found.items()]
    columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "odd", "out_step", "in_step", "top"])


@dataclass
class Place:
    """How a range begins: within a string or not, how deep, and the open container's key, opener and number of elements that have begun; opener is empty outside containers."""

    inside: bool = False
    depth: int = 0
    key: str | None = None
    opener: str = ""
    begun: int = 0


def _events(data: bytes, place: Place, base: int) -> list[tuple[int, int, str | None]]:
    """(position, byte, key) of what begins or ends elements of containers that stand base deep: an opening bracket, with its key, a comma, a closing one. place moves behind data."""
    at, kinds, odd = _marks(data)
    outside = ~(odd ^ place.inside) & (kinds != QUOTE)
    place.inside ^= bool(len(odd) and odd[-1])
    at, kinds = at[outside], kinds[outside]
    steps = STEP[kinds]
    depth = place.depth + np.cumsum(steps)
    place.depth = int(depth[-1]) if len(depth) else place.depth
    found = np.flatnonzero(((steps >= 0) & (depth == base) & ((steps == 1) | (kinds == COMMA))) | ((steps == -1) & (depth == base - 1)))
    out = []
    for e in found.tolist():
        i, key = int(at[e]), None
        if steps[e] == 1:  # the key stands between the mark before and the bracket, in the same record
            told = KEY.search(data[int(at[e - 1]) + 1 if e else 0 : i])
            key = json.loads(b'"' + told[1] + b'"') if told else None
        out.append((i, int(kinds[e]), key))
    return out


def _states(records: DataFrame) -> tuple[dict[tuple[str, int], Place], dict[str, str]]:
    """How each range begins, as far as strings and depth go, and each file's first character."""
    rows = records.mapInArrow(_summaries, "file string, start long, odd boolean, out_step long, in_step long, top string").collect()
    places, tops, inside, depth = {}, {}, False, 0
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        if r.file not in tops:
            inside, depth = False, 0
        tops[r.file] = tops.get(r.file) or r.top
        places[r.file, r.start] = Place(inside, depth)
        depth += r.in_step if inside else r.out_step
        inside ^= r.odd
    return places, tops


def _numbered(records: DataFrame, base: dict[str, int], places: dict[tuple[str, int], Place]) -> dict[str, list[tuple[str | None, str]]]:
    """Fills in the open container and the number of elements at each range's beginning; returns each file's containers (key, opener)."""
    told = records.sparkSession.sparkContext.broadcast((base, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, places = told.value
        found: dict[tuple[str, int], tuple[Place, dict]] = {}
        for file, start, data in _ranges(batches):
            if file in base:
                # begun counts commas until a container opens or closes, and its elements from then on
                place, row = found.setdefault((file, start), (replace(places[file, start]), {"keys": [], "openers": [], "same": True, "key": None, "opener": "", "begun": 0}))
                for _, kind, key in _events(data, place, base[file]):
                    if kind == COMMA:
                        row["begun"] += 1
                    elif STEP[kind] == 1:
                        row |= {"same": False, "key": key, "opener": chr(kind), "begun": 1}
                        row["keys"].append(key)
                        row["openers"].append(chr(kind))
                    else:
                        row |= {"same": False, "key": None, "opener": "", "begun": 0}
        rows = [{"file": file, "start": start} | row for (file, start), (_, row) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("start", pa.int64()), ("keys", pa.list_(pa.string())), ("openers", pa.list_(pa.string())), ("same", pa.bool_()), ("key", pa.string()), ("opener", pa.string()), ("begun", pa.int64())]))

    rows = records.mapInArrow(run, "file string, start long, keys array<string>, openers array<string>, same boolean, key string, opener string, begun long").collect()
    containers: dict[str, dict] = {}
    key, opener, begun = None, "", 0
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        if r.file not in containers:
            key, opener, begun, containers[r.file] = None, "", 0, {}
        place = places[r.file, r.start]
        place.key, place.opener, place.begun = key, opener, begun
        containers[r.file].update(dict.fromkeys(zip(r["keys"], r.openers, strict=True)))
        key, opener, begun = (key, opener, begun + r.begun) if r.same else (r.key, r.opener, r.begun)
    return {file: list(c) for file, c in containers.items()}


def _elements(records: DataFrame, base: dict[str, int], places: dict[tuple[str, int], Place]) -> DataFrame:
    """(file, key, opener, pos, start, text, whole): elements, those that reach over ranges in parts."""
    told = records.sparkSession.sparkContext.broadcast((base, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, places = told.value
        current, place, held, cut, rows = None, None, [], False, []
        names = ["file", "key", "opener", "pos", "start", "text", "whole"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]

        def given(whole: bool) -> None:
            """What is held of the current element; held begins anew."""
            if place.opener:
                rows.append((current[0], place.key, place.opener, place.begun - 1, current[1], b"".join(held), whole and not cut))
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for file, start, data in _ranges(batches):
            if (file, start) != current:
                if place is not None:
                    given(False)
                current, place = (file, start), replace(places[file, start]) if file in base else None
                cut = place is not None and bool(place.opener)
            if place is None:
                continue
            since = 0
            for i, kind, key in _events(data, place, base[file]):
                if STEP[kind] == 1:
                    place.key, place.opener, place.begun = key, chr(kind), 1
                else:
                    held.append(data[since:i])
                    given(True)
                    if kind == COMMA:
                        place.begun += 1
                    else:
                        place.key, place.opener, place.begun = None, "", 0
                since, cut = i + 1, False
            if place.opener:
                held.append(data[since:])
            if rows:
                yield batch()
        if place is not None:
            given(False)
        yield batch()

    return records.mapInArrow(run, "file string, key string, opener string, pos long, start long, text binary, whole boolean")


@dataclass
class Split:
    """What is known of JSON files: records, each file's first character, how deep its elements are, how its ranges begin, and its containers (key, opener)."""

    records: DataFrame
    tops: dict[str, str]
    base: dict[str, int]
    places: dict[tuple[str, int], Place]
    containers: dict[str, list[tuple[str | None, str]]]

    def elements(self, wanted: list[tuple[str, str | None]] | None = None) -> DataFrame:
        """(file, key, pos, text) of all containers, or of those wanted (file, key). pos counts from 0 in each container; an empty one has none."""
        parts = _elements(self.records, self.base, self.places)
        if wanted is not None:
            same = [(F.col("file") == f) & F.col("key").eqNullSafe(F.lit(k)) for f, k in wanted]
            parts = parts.filter(reduce(or_, same, F.lit(False)))
        whole = parts.filter("whole").select("file", "key", "pos", "text")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: F.hex(p["text"])), "")
        pieced = parts.filter("NOT whole").groupBy("file", "key", "pos").agg(F.unhex(joined).alias("text"))
        told = whole.union(pieced).withColumn("text", F.decode("text", "UTF-8"))
        return told.filter(F.btrim("text", F.lit(" \t\r\n")) != "")


def split(spark: SparkSession, path: str, lists_under_keys: bool) -> Split:
    """path: one file or several. Elements of a list are its own; those of an object are its members (texts "key": value), or, with lists_under_keys, what its members' lists and objects hold."""
    records = _records(spark, path)
    places, tops = _states(records)
    base = {file: 2 if top == "{" and lists_under_keys else 1 for file, top in tops.items() if top in ("[", "{")}
    return Split(records, tops, base, places, _numbered(records, base, places))
