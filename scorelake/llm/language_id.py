"""Operator 8: language identification by bit-sliced Bloom filters of n-grams.

The filters of all languages share their hash functions and lie side by side: a slot holds one bit for each language, so the AND of an
n-gram's slots names every language that contains it, at the price of one look-up. A text's n-grams are each letter with its two
neighbours (lower-cased; anything but a letter counts as one blank). Per-language popcounts of the masks, less what each filter's
false positives are expected to add, decide.

Fitting reads at most SAMPLE different texts of each language, drawn by a hash: the model's size is bounded by theirs, whatever the corpus. An n-gram belongs to the languages where it is at least SHARE as frequent as where it is most frequent.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import small_batches, spare

#: Labelled rows of each language that fitting reads at most, equal texts counting as one: the bound of the sample.
SAMPLE = 2000
#: Occurrences in the sample that an n-gram needs, and its least frequency against the language where it is most frequent.
LEAST, SHARE = 3, 0.5
#: Slots for each n-gram; look-ups of each.
SLOTS, LOOKUPS = 16, 2
#: Code points handled at a time.
STEP = 1 << 18
#: Label of texts without a letter.
NONE = "und"
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            out[i] = ord(small) if len(small) == 1 else i
    return out


def gram_codes(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each letter with what stands before and after it, a step at a time."""
    for at in range(0, len(text), STEP):
        piece = text[max(0, at - 1) : at + STEP + 1]
        codes = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at == 0:
            codes = np.concatenate([[0], codes]).astype(np.uint32)
        if at + STEP >= len(text):
            codes = np.concatenate([codes, [0]]).astype(np.uint32)
        here = np.flatnonzero(codes[1:-1]) + 1
        yield codes[here - 1], codes[here], codes[here + 1]


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * _ODD[0] + b.astype(np.uint64) * _ODD[1] + c.astype(np.uint64) * _ODD[2]
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    return x ^ (x >> np.uint64(29))


@dataclass
class Filters:
    languages: list[str]
    #: (slots, words of 64 languages)
    slots: np.ndarray

    @classmethod
    def of(cls, grams: dict[str, list[str]]) -> Filters:
        languages = sorted(grams)
        total = sum(map(len, grams.values()))
        size = 1 << max(10, (SLOTS * max(1, total) - 1).bit_length())
        slots = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
        out = cls(languages, slots)
        for i, language in enumerate(languages):
            if grams[language]:
                codes = np.array([[ord(c) for c in g] for g in grams[language]], np.uint32).T
                for at in out._places(*codes):
                    np.bitwise_or.at(slots[:, i // 64], at, np.uint64(1 << i % 64))
        return out

    def _places(self, a, b, c) -> list[np.ndarray]:
        h, last = _hash(a, b, c), np.uint64(len(self.slots) - 1)
        return [((h >> np.uint64(31 * k)) & last).astype(np.int64) for k in range(LOOKUPS)]

    @property
    def learnt(self) -> bool:
        """Whether any language has an n-gram."""
        return bool(self.slots.any())

    @property
    def false_rates(self) -> np.ndarray:
        """How often a language's filter says yes to an n-gram that it doesn't contain."""
        if not hasattr(self, "_rates"):
            bits = [(self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(self.languages))]
            self._rates = np.array([float(b.mean()) ** LOOKUPS for b in bits])
        return self._rates

    def popcounts(self, text: str) -> tuple[int, np.ndarray]:
        n, hits = 0, np.zeros(len(self.languages), np.int64)
        for codes in gram_codes(text):
            if not len(codes[0]):
                continue
            n += len(codes[0])
            first, *others = self._places(*codes)
            mask = self.slots[first]
            for at in others:
                mask = mask & self.slots[at]
            for word in range(mask.shape[1]):
                here = range(64 * word, min(64 * word + 64, len(self.languages)))
                if len(here) <= 8:
                    seen = np.bincount(mask[:, word].astype(np.int64), minlength=256)
                    for i in here:
                        hits[i] += seen[[m for m in range(256) if m >> i % 64 & 1]].sum()
                else:
                    for i in here:
                        hits[i] += np.count_nonzero(mask[:, word] & np.uint64(1 << i % 64))
        return n, hits

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of the text's n-grams that it explains, corrected for false positives."""
        n, hits = self.popcounts(text or "")
        if not n or not self.languages:
            return NONE, 0.0
        rates = self.false_rates
        own = np.clip((hits - rates * n) / np.maximum(1 - rates, 1e-9), 0, n)
        best = int(np.argmax(own))
        return self.languages[best], float(own[best] / n)


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters of labelled's languages, from at most sample different texts of each; rows without text or language are left out.

    A text is drawn, or not, with all its copies, which meet as partial sums, so it doesn't matter how often it is repeated.
    """
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).filter("text is not null and lang is not null")
    draw = F.xxhash64("text", "lang")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(draw).alias("n")).collect()}  # one row for each language
    if not counts:
        return Filters.of({})
    spread = 1 << 20
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(spread, int(spread * 1.2 * sample / max(n, 1)) + 1)))])
    drawn = rows.withColumn("draw", draw).filter(F.pmod("draw", F.lit(spread)) < share[F.col("lang")]).groupBy("lang", "draw").agg(F.first("text").alias("text"))
    drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("n") <= sample).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                for a, b, c in gram_codes(text.as_py()):
                    codes, n = np.unique(np.stack([a, b, c], 1), axis=0, return_counts=True)
                    for gram, times in zip(codes.tolist(), n.tolist(), strict=True):
                        seen[lang.as_py(), "".join(map(chr, gram))] += times
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

    grams = drawn.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = grams.filter(F.col("n") >= LEAST)
    table: dict[str, dict[str, int]] = {lang: {} for lang in counts}
    for r in grams.select("lang", "gram", "n").collect():  # what SAMPLE texts of each language hold, LEAST times at least
        table[r.lang][r.gram] = r.n
    totals = {lang: max(1, sum(own.values())) for lang, own in table.items()}
    most: dict[str, float] = {}
    for lang, own in table.items():
        for gram, n in own.items():
            most[gram] = max(most.get(gram, 0), n / totals[lang])
    return Filters.of({lang: sorted(g for g, n in own.items() if n / totals[lang] >= SHARE * most[g]) for lang, own in table.items()})


def predict(docs: DataFrame, filters: Filters, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per row of docs: the columns of carry, lang_pred string, score double (0 to 1: the share of n-grams explained); out are these two's names, which carry must not have.

    A text that is null or has no letter gets und and 0; any other the best learnt language (ties to the first by name; und if none
    was learnt). Repeated rows give repeated results. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the n-grams of SAMPLE texts of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*carry, *out])

    plain = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(text_column).alias(spare(list(carry), "whole")[0]))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{kept}`{out[0]}` string, `{out[1]}` double")


def lettered(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index(text_column)
        for batch in batches:
            kept = [any(len(codes[0]) for codes in gram_codes(text.as_py() or "")) for text in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Documents that take no part in learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_and_predict(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """id, held_out boolean, lang_pred string, score double for each row of docs; learns from rows that aren't held out. A null id isn't held out."""
    filters = fit(docs.filter(~held_out(F.col(id_column))), text_column, lang_column)
    found = predict(docs, filters, text_column, (id_column,))
    return found.select(F.col(id_column), held_out(F.col(id_column)).alias("held_out"), "lang_pred", "score")
