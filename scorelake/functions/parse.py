"""Readings of free-text answers: choices, numbers, time spans and timed captions, as column expressions.

A number is digits, dots and digits; text of that form that is no number (two dots) makes a reading fail, never the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.temporal import SEGMENT, segment

# The phrase before a choice, the words that announce times, the seconds around a single time, and the patterns of numbers and ranges.
CHOICE_PHRASE = "best option:"
TIME_WORDS = ["starts", "ends", "happens in", "start time", "end time"]
RADIUS = 20
NUMBER = r"\d+\.*\d*"
DASH = rf"({NUMBER})\s*-\s*({NUMBER})"
TO = rf"({NUMBER})\s* to \s*({NUMBER})"


def bracketed_letter(text: Column) -> Column:
    """The first single letter in brackets, lower case, or null."""
    return F.lower(F.nullif(F.regexp_extract(text, r"\(([A-Za-z])\)", 1), F.lit("")))


def leading_letter(text: Column) -> Column:
    """The letter before any `.`, `,`, space or `)` at the start of an answer (or its only one), lower case; `` for a blank answer, else null."""
    rest = _bare(text)
    alone = (F.length(rest) == 1) | F.substring(rest, 2, 1).isin(".", ",", " ", ")")
    return F.when(rest == "", "").when(alone, F.substring(rest, 1, 1))


LETTERS = "abcde"


def option_lines(options: Column) -> Column:
    """Options as they stand in a question: `(A) text`; a pair, written as a JSON list of two, as `a - b`."""
    plain = lambda o: F.regexp_replace(o, r"^\s*\[\s*\"?([^,\"]*?)\"?\s*,\s*\"?([^,\"]*?)\"?\s*\]\s*$", "$1 - $2")
    return F.transform(options, lambda o, i: F.concat(F.lit("("), F.substring(F.lit(LETTERS.upper()), (i + 1).cast("int"), F.lit(1)), F.lit(") "), plain(o)))


def likest(text: Column, options: Column, similarity: Callable[[Column, Column], Column]) -> Column:
    """The letter of the option most similar to a text, the first among equals; null without options. A similarity that finds the place itself does so (its attribute best)."""
    if best := getattr(similarity, "best", None):
        return F.when(F.size(options) > 0, F.substring(F.lit(LETTERS), best(text, option_lines(options)) + 1, F.lit(1)))
    scored = F.transform(option_lines(options), lambda o, i: F.struct(similarity(text, o).alias("sim"), (-i).alias("i")))
    return F.when(F.size(options) > 0, F.substring(F.lit(LETTERS), (1 - F.array_max(scored)["i"]).cast("int"), F.lit(1)))


def _bare(text: Column) -> Column:
    """An answer without its phrase, and without brackets and white space at its start."""
    low = F.lower(text)
    rest = F.when(low.startswith(CHOICE_PHRASE), F.substring(low, F.lit(len(CHOICE_PHRASE) + 1), F.length(low))).otherwise(low)
    return F.regexp_replace(rest, r"^\s*\(*\s*", "")


def choice(text: Column, gold: Column, options: Column | None = None, similarity: Callable[[Column, Column], Column] | None = None) -> Column:
    """struct(hit, failed) of a choice against a letter: by the bracketed letter, or else the leading one, or else, with options and a similarity, by the option most similar to the answer.
    Blank answers fail, and those with neither letter; these may still be hits by similarity."""
    first, second = bracketed_letter(text), leading_letter(text)
    hit = F.coalesce(first == gold, F.lit(False)) | F.coalesce((second == gold) & (second != ""), F.lit(False))
    blank = F.coalesce(second == "", F.lit(False)) | text.isNull()
    failed = ~hit & (blank | (first.isNull() & second.isNull()))
    if options is not None and similarity is not None:
        hit = hit | (~blank & F.coalesce(likest(_bare(text), options, similarity) == gold, F.lit(False)))
    return F.struct(hit.alias("hit"), failed.alias("failed"))


def leading_choice(text: Column, gold: Column, options: Column | None = None, similarity: Callable[[Column, Column], Column] | None = None) -> Column:
    """struct(hit, failed) of a choice that is read at the start of an answer alone: a letter of an option decides there, right or wrong; other answers go by similarity, if there is one.
    Blank answers fail, and, without a similarity, those without a letter. Without options there are four letters."""
    letter = leading_letter(text)
    n = F.lit(4) if options is None else F.coalesce(F.when(F.size(options) > 0, F.size(options)), F.lit(4))
    known = F.coalesce((letter != "") & (F.instr(F.lit(LETTERS), letter) > 0) & (F.instr(F.lit(LETTERS), letter) <= n), F.lit(False))
    blank = F.coalesce(letter == "", F.lit(False)) | text.isNull()
    hit, failed = known & F.coalesce(letter == gold, F.lit(False)), blank | ~known
    if options is not None and similarity is not None:
        like = likest(_bare(text), options, similarity)
        hit, failed = F.when(known | blank, hit).otherwise(F.coalesce(like == gold, F.lit(False))), blank | (~known & like.isNull())
    return F.struct(hit.alias("hit"), failed.alias("failed"))


def first_number(text: Column) -> Column:
    """The first number with its sign, decimals before whole ones at the same place; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"[-+]?\d*\.\d+|[-+]?\d+", 0), F.lit("")).try_cast("double")


def _pairs(starts: Column, ends: Column) -> Column:
    return F.zip_with(starts, ends, lambda a, b: segment(a.try_cast("double"), b.try_cast("double")))


def _all(text: Column, pattern: str) -> Column:
    return _pairs(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))


def _paired(numbers: Column) -> Column:
    """Consecutive numbers in twos; a last odd one is left out."""
    n = F.floor(F.size(numbers) / 2).cast("int")
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: segment(F.get(numbers, 2 * i).try_cast("double"), F.get(numbers, 2 * i + 1).try_cast("double")))
    return F.when(n > 0, many).otherwise(F.array().cast(f"array<{SEGMENT}>"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once."""
    return F.get(F.transform(F.array(value), body), 0)


def time_spans(text: Column) -> Column:
    """Intervals of an answer: all of the form `a - b`, or else `a to b`, or else the numbers of sentences with a word of time, in twos. Null if there are none or one is no number."""

    def told(low: Column) -> Column:
        timed = F.filter(F.split(low, r"[!?\n]"), lambda s: F.exists(F.array(*map(F.lit, TIME_WORDS)), lambda w: F.contains(s, w)))
        return _once(F.flatten(F.transform(timed, lambda s: F.regexp_extract_all(s, F.lit(r"\b(\d+\.\d+\b|\b\d+)\b"), F.lit(1)))), _paired)

    def read(low: Column) -> Column:
        return _once(_all(low, DASH), lambda dashes: F.when(F.size(dashes) > 0, dashes).otherwise(_once(_all(low, TO), lambda tos: F.when(F.size(tos) > 0, tos).otherwise(told(low)))))

    whole = lambda found: F.when((F.size(found) > 0) & ~F.exists(found, lambda s: s["start"].isNull() | s["end"].isNull()), found)
    return _once(F.lower(text), lambda low: F.when(low.isNotNull(), _once(read(low), whole)))


def _trimmed(caption: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(caption, r"^\s+|\s+$", ""), r"^[, ]+|[, \s]+$", "")


def paragraph_captions(text: Column) -> Column:
    """array of struct(span, sentence): intervals `a - b` of a paragraph, and the texts between them of over 5 characters, one by one as far as both go."""
    low = F.lower(text)
    spans = _all(low, DASH)
    rest = F.replace(F.regexp_replace(low, rf"{NUMBER}\s*-\s*{NUMBER}", "\n"), F.lit("seconds"), F.lit(""))
    captions = F.transform(F.filter(F.split(rest, "\n"), lambda c: F.length(c) > 5), _trimmed)
    n = F.least(F.size(spans), F.size(captions))
    return F.zip_with(F.slice(spans, F.lit(1), n), F.slice(captions, F.lit(1), n), lambda s, c: F.struct(s.alias("span"), c.alias("sentence")))


def time_part(text: Column) -> Column:
    """An interval: the first `a - b`; or of one number t, RADIUS around it (from t on, if it is no larger than RADIUS); or of two numbers; else null."""
    ranged = F.get(_all(text, DASH), 0)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(rf"{NUMBER}(?!\.)"), F.lit(0)), lambda x: x.try_cast("double"))
    one, two = F.get(numbers, 0), F.get(numbers, 1)
    around = F.when(one > RADIUS, segment(one - RADIUS, one + RADIUS)).otherwise(segment(one, one + 2 * RADIUS))
    return F.when(ranged.isNotNull(), ranged).when(F.size(numbers) == 1, around).when(F.size(numbers) == 2, segment(one, two))


def line_captions(text: Column) -> Column:
    """array of struct(span, sentence) by lines (or sentences, without line feeds) of over 7 characters: the time stands before the word `seconds`, the caption after the last one."""
    parts = F.when(F.contains(text, F.lit("\n")), F.split(text, "\n")).otherwise(F.transform(F.split(text, r"\."), lambda c: F.concat(c, F.lit("."))))
    long = F.filter(parts, lambda c: F.length(c) > F.when(F.contains(text, F.lit("\n")), 7).otherwise(8))
    read = F.transform(long, lambda c: F.struct(time_part(F.get(F.split(c, "seconds"), 0)).alias("t"), F.split(c, "seconds").alias("p")))
    good = F.filter(read, lambda r: (F.size(r["p"]) >= 2) & r["t"]["start"].isNotNull() & r["t"]["end"].isNotNull())
    return F.transform(good, lambda r: F.struct(segment(F.round(r["t"]["start"], 2), F.round(r["t"]["end"], 2)).alias("span"), F.regexp_replace(F.element_at(r["p"], -1), r"^\s+|\s+$", "").alias("sentence")))


def timed_captions(text: Column) -> Column:
    """A dense caption's intervals and sentences, by paragraph or else by line; null if there are none or a time is no number."""
    whole = paragraph_captions(text)
    found = F.when(F.size(whole) > 0, whole).otherwise(line_captions(text))
    broken = F.exists(found, lambda r: r["span"]["start"].isNull() | r["span"]["end"].isNull())
    return F.when((F.size(found) > 0) & ~broken, found)
