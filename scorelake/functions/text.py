"""Text normalisation, tokens and yes/no readings as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and phrases that the scene score counts.
OBJECT_WORDS = [
    "person", "people", "man", "woman", "child", "baby", "dog", "cat", "car", "house",
    "tree", "building", "road", "sky", "water", "table", "chair", "book", "phone",
    "computer", "ball", "bird", "flower", "grass", "mountain", "cloud", "sun",
]
RELATION_PHRASES = [
    "on", "in", "under", "over", "next to", "behind", "in front of", "near",
    "holding", "wearing", "sitting", "standing", "walking", "running", "looking",
]
# The words that count as a yes or a no.
YES_WORDS = ["yes", "true", "correct", "affirmative"]
NO_WORDS = ["no", "false", "incorrect", "negative"]
# What marks a prediction that a content filter has withheld, and the score's weights and full marks.
FILTER_MARK = "[Content filtered"
AUDIT_MARKS = ["Content filtered", "content_filter"]
SCENE_WEIGHTS = {"words": (0.3, 50), "objects": (0.4, 10), "relations": (0.3, 5)}


# The rules of Treebank tokens for lower-case text, in their order, as patterns that Java and RE2 read alike. What they remove is punctuation, which caption scores leave out.
TREEBANK_SPLITS = [
    ("[‘’`´]", "'"),
    ("''+|[“”«»\"]", " "),
    ("[.][.]+|…|--+|[–—]", " "),
    (r"[?!;(){}\[\]<>]", " "),
    (r"([@#$%&*])", r" \1 "),
    (r"[,:]+([^0-9,:])", r" \1"),
]
# Words whose last period belongs to them; endings that are a token, and tokens that begin with their quote; words that are two tokens.
TREEBANK_ABBREVIATIONS = r"^(mr|mrs|ms|dr|st|prof|jr|sr|vs|etc|[a-z]|[a-z](\.[a-z])+)\.$"
TREEBANK_ENDINGS = r"^(.*[^'])(n't|'s|'m|'d|'ll|'re|'ve)$"
TREEBANK_ALONE = "^'(s|m|d|t|n|ll|re|ve|ye)$"
TREEBANK_PAIRS = {"cannot": "can not", "d'ye": "d 'ye", "gimme": "gim me", "gonna": "gon na", "gotta": "got ta", "lemme": "lem me", "more'n": "more 'n", "'tis": "'t is", "'twas": "'t was", "wanna": "wan na"}


def normalise(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def words(text: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def plain_words(text: Column) -> Column:
    """Words of a text, in lower case, by white space."""
    return words(normalise(text))


def treebank(text: Column) -> Column:
    """Treebank tokens of a text, in lower case, without punctuation: quotes, brackets, dashes and marks at ends go, symbols stand alone, contractions are two tokens, abbreviations keep their
    period, and numbers their commas, colons and points. A null text has none."""
    spaced = F.concat(F.lit(" "), normalise(text), F.lit(" "))
    for pattern, to in TREEBANK_SPLITS:
        spaced = F.regexp_replace(spaced, pattern, to.replace("\\", "$"))
    pairs = F.create_map(*[F.lit(x) for pair in TREEBANK_PAIRS.items() for x in pair])

    def ended(t: Column) -> Column:
        """Without a closing quote, and without a last period that isn't an abbreviation's."""
        open_end = F.rtrim(t, F.lit("'"))
        return F.when(open_end.rlike(TREEBANK_ABBREVIATIONS), open_end).otherwise(F.regexp_replace(t, "[.']+$", ""))

    def parted(t: Column) -> Column:
        bare = F.coalesce(F.try_element_at(pairs, t), F.when(t.rlike(TREEBANK_ALONE), t), F.ltrim(t, F.lit("'")))
        return F.regexp_replace(bare, TREEBANK_ENDINGS, "$1 $2")

    parts = F.transform(F.transform(F.split(F.trim(spaced), " +"), ended), parted)
    return F.filter(F.split(F.array_join(parts, " "), " +"), lambda t: ~t.rlike("^[-.',:]*$"))


_SPLITS = [(re.compile(pattern), to) for pattern, to in TREEBANK_SPLITS]
_ABBREVIATION, _ENDING, _ALONE, _PUNCTUATION, _LAST = map(re.compile, (TREEBANK_ABBREVIATIONS, TREEBANK_ENDINGS, TREEBANK_ALONE, "^[-.',:]*$", "[.']+$"))


def treebank_parts(word: str) -> list[str]:
    """The tokens that treebank gives for one word of a normalised text: no rule reaches over a space, but for that of commas and colons, which takes one in. For tasks that meet the same words again and keep their tokens."""
    if word.isalnum():
        return TREEBANK_PAIRS.get(word, word).split(" ")
    if word[:-1].isalnum() and word[-1] in ".,:;?!":  # words at the end of a clause, most of the rest
        return [word] if word[-1] == "." and _ABBREVIATION.search(word) else treebank_parts(word[:-1])
    spaced = f" {word} "
    for pattern, to in _SPLITS:
        spaced = pattern.sub(to, spaced)
    out = []
    for t in spaced.split(" "):
        open_end = t.rstrip("'")
        t = open_end if _ABBREVIATION.search(open_end) else _LAST.sub("", t)
        t = TREEBANK_PAIRS.get(t) or (t if _ALONE.search(t) else t.lstrip("'"))
        out += _ENDING.sub(r"\1 \2", t).split(" ")
    return [t for t in out if not _PUNCTUATION.search(t)]


def ngrams(tokens: Column, n: int) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, many).otherwise(F.array().cast("array<string>"))


def strip_fences(text: Column) -> Column:
    """The body of a fenced block; other text as it is, without white space at its ends."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(bare, r"^```(?:json|python)?\s*", ""), r"\s*```$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(bare)


def answer_prefix(text: Column) -> Column:
    """`Yes.` or `No.` by how the answer begins, else null."""
    low = F.lower(text)
    return F.when(low.startswith("yes"), "Yes.").when(low.startswith("no"), "No.")


def judge_prefix(text: Column) -> Column:
    """`yes` or `no` by how a judge's reply begins, without emphasis; else null."""
    low = F.lower(F.regexp_replace(F.regexp_replace(text, r"\*", ""), r"^\s+", ""))
    return F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no")


def _whole(low: Column, options: list[str]) -> Column:
    return low.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(options)})($|[^\p{{L}}\p{{N}}_])")


def yes_no(text: Column) -> Column:
    """true for a word of assent, else false for one of denial, else null; assent is looked for first."""
    low = F.lower(text)
    return F.when(_whole(low, YES_WORDS), True).when(_whole(low, NO_WORDS), False)


def valid_pattern(pattern: Column) -> Column:
    """The pattern, or null if it is none. Texts of letters, digits and spaces are taken as they are; others are tried once in a row."""
    tried = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
    return F.when(pattern.rlike(r"^[A-Za-z0-9 ]*$") | tried.isNotNull(), pattern)


def has_word(text: Column, pattern: Column) -> Column:
    """Whether the text has the pattern (a regular expression of the data) as a whole word, in any case. Null for a pattern that is none by itself, as `yes (`; a null text or pattern has no word."""
    valid = valid_pattern(pattern)
    found = F.regexp_like(text, F.concat(F.lit(r"(?i)\b("), valid, F.lit(r")\b")))
    return F.when(valid.isNotNull() | pattern.isNull(), F.coalesce(found, F.lit(False)))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def single_quoted(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit("'"))


def split_last(text: Column, sep: str = "_") -> Column:
    """The parts before and after the last separator; without one, the text and null."""
    at = F.length(text) - F.locate(sep, F.reverse(text)) + 1
    found = F.contains(text, F.lit(sep))
    return F.struct(F.when(found, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("head"), F.when(found, F.substring(text, at + 1, F.length(text))).alias("tail"))


def stem_of_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def percent(value: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", value * 100)


def fixed(value: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f", value)


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def objects_in(low: Column) -> Column:
    """Known objects among the words of a normalised text."""
    return F.array_intersect(words(low), F.array(*map(F.lit, OBJECT_WORDS)))


def relations_in(low: Column) -> Column:
    """Known relation phrases that a normalised text contains."""
    return F.filter(F.array(*map(F.lit, RELATION_PHRASES)), lambda r: F.contains(low, r))


def scene_score(text: Column) -> Column:
    """A weighted score from 0 to 1 of the number of words, known objects and relations; 0 for null or empty."""

    def score(low: Column) -> Column:
        counts = {"words": F.size(words(low)), "objects": F.size(objects_in(low)), "relations": F.size(relations_in(low))}
        total = sum((F.lit(w) * F.least(F.lit(1.0), counts[k] / F.lit(float(full))) for k, (w, full) in SCENE_WEIGHTS.items()), F.lit(0.0))
        return F.least(F.lit(1.0), total)

    # the array of one element holds the normalised text, so that it is made once
    return F.when(text.isNull() | (text == ""), 0.0).otherwise(F.get(F.transform(F.array(normalise(text)), score), 0))


def is_filtered(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(FILTER_MARK)), F.lit(False))


def audit_filtered(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(AUDIT_MARKS[0])) | F.contains(F.lower(text), F.lit(AUDIT_MARKS[1])), F.lit(False))


def shortened(text: Column, most: int) -> Column:
    """The first so many characters, for display."""
    return F.substring(text, 1, most)


def encoded(data: Column) -> Column:
    """Bytes in base64, on one line."""
    return F.regexp_replace(F.base64(data), r"\s", "")
