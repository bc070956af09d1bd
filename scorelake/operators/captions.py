"""Scores of texts against references by bags of n-grams.

Words and n-grams are 64-bit hashes. Corpus BLEU and the caption suite count the n-grams of each pair where its row is, in slices of Arrow batches, and only sums are shuffled. For the others, a pair's texts are shuffled once, by its key; both sides' n-grams of all orders are exploded and counted in the
partition where their key is, so nothing but sums leaves it, and a text of any length takes no memory of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.functions.alignment import meteor
from scorelake.functions.porter import stem
from scorelake.functions.temporal import f1, ratio


def tokens(column: str) -> Column:
    return text.plain_words(F.col(column))


def _hashed(column: str, split: Callable[[Column], Column] = text.plain_words) -> Column:
    return F.transform(split(F.col(column)), lambda w: F.xxhash64(w))


def _grams(words: Column, n: int) -> Column:
    """Hashes of the n-grams of hashed words."""
    if n == 1:
        return words
    many = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    return F.when(F.size(words) >= n, many).otherwise(F.array().cast("array<long>"))


def _by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows by the last of keys, in as many partitions as shuffles have: their n-grams are many times their texts, so few large partitions wouldn't do."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys[-1:])


def bags(rows: DataFrame, keys: list[str], candidate: str, reference: str, orders: tuple[int, ...], split: Callable[[Column], Column] = text.plain_words) -> DataFrame:
    """(keys, n, gram, c, r): how often each n-gram stands in the candidates and in the references of a key, for each order n; and for each key a row of order 0, without a gram, so that keys without words are there."""
    held = _by_key(rows.select(*keys, candidate, reference), keys).select(*keys, _hashed(candidate, split).alias("a"), _hashed(reference, split).alias("b"))
    part = lambda n, side, grams: F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), grams.alias("grams"))
    parts = F.array(part(0, 0, F.array(F.lit(0).cast("long"))), *[part(n, i, _grams(F.col(side), n)) for n in orders for i, side in enumerate("ab")])
    each = held.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.n", "x.side", F.explode("x.grams").alias("gram"))
    return each.groupBy(*keys, "n", "gram").agg(F.sum(1 - F.col("side")).alias("c"), F.sum("side").alias("r"))


def matches(rows: DataFrame, key: str, candidate: str, reference: str, orders: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(key, n, matched (clipped), n_candidate, n_reference) of both texts' n-grams, a row for each order that either has."""
    return _counted(rows, [key], candidate, reference, orders).filter("n > 0")


def _counted(rows: DataFrame, keys: list[str], candidate: str, reference: str, orders: tuple[int, ...], split: Callable[[Column], Column] = text.plain_words) -> DataFrame:
    met = bags(rows, keys, candidate, reference, orders, split)
    return met.groupBy(*keys, "n").agg(F.sum(F.least("c", "r")).alias("matched"), F.sum("c").alias("n_candidate"), F.sum("r").alias("n_reference"))


def _wide(counted: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key: matched1, n_candidate1, ... of the orders up to 4; 0 where there is none."""
    return counted.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in (1, 2, 3, 4) for c in ("matched", "n_candidate", "n_reference")])


#: Characters of a slice of pairs whose n-grams are counted together, and words whose tokens a task keeps.
SLICE, MEMO = 1 << 21, 1 << 17
ORDERS = (1, 2, 3, 4)
COUNTS = [f"{c}{n}" for n in ORDERS for c in ("matched", "n_candidate", "n_reference")]


class _Memo(dict):
    """Hashes of a word's tokens, made once; begun anew after MEMO words."""

    def __init__(self, parts: Callable[[str], list[str]]):
        self.parts = parts

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = [hash(t) for t in self.parts(word)]
        return out


def _gram_hashes(words: np.ndarray, row: np.ndarray, mix: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, hashes of the n-grams of hashed words, which hold the row (or what mix has for it), and their rows."""
    with np.errstate(over="ignore"):
        own, grams = (row if mix is None else mix[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros_like(words)
        for n in ORDERS:
            of = row[: max(0, len(row) - n + 1)]
            grams = (grams[: len(of)] ^ (grams[: len(of)] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[n - 1 :]
            inside = of == row[n - 1 :]
            mixed = (grams[inside] ^ own[: len(of)][inside]) * np.uint64(0x94D049BB133111EB)
            yield mixed ^ (mixed >> np.uint64(31)), of[inside]


def _slice_counts(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """COUNTS of pairs of hashed words: for each order the clipped matches and both sides' n-grams, by pair."""
    rows = len(a)
    flat = lambda side: (np.concatenate(side), np.repeat(np.arange(rows), [len(x) for x in side]))
    out = []
    for (grams, row), (others, other_row) in zip(_gram_hashes(*flat(a)), _gram_hashes(*flat(b)), strict=True):
        known, at, r = np.unique(others, return_index=True, return_counts=True)
        matched = np.zeros(rows)
        if len(known):
            some = np.zeros(1 << 20, bool)  # most n-grams that the other side lacks end here
            some[known >> np.uint64(44)] = True
            grams_met = grams[some[grams >> np.uint64(44)]]
            place = np.minimum(np.searchsorted(known, grams_met), len(known) - 1)
            c = np.bincount(place[known[place] == grams_met], minlength=len(known))
            matched = np.bincount(other_row[at], np.minimum(c, r), rows)
        out += [matched.astype(np.int64), np.bincount(row, minlength=rows), np.bincount(other_row, minlength=rows)]
    return out


def pair_counts(rows: DataFrame, keys: list[str], candidate: str, reference: str, split: Callable[[Column], Column] = text.plain_words) -> DataFrame:
    """(keys, COUNTS): a row for each pair: of the orders 1 to 4 its clipped matches and both sides' n-grams. A null text has none. Words are those that split gives; they have no spaces."""
    parts = text.treebank_parts if split is text.treebank else None
    told = text.normalise if split in (text.treebank, text.plain_words) else lambda c: F.array_join(split(c), " ")
    kept = rows.select(*keys, told(F.col(candidate)).alias("a"), told(F.col(reference)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(parts) if parts else None

        def hashed(value: str) -> np.ndarray:
            words = value.split(" ") if value else []
            return np.fromiter(chain.from_iterable(map(memo.__getitem__, words)) if parts else map(hash, words), np.int64).view(np.uint64)

        for batch in batches:
            first, size, sides = 0, 0, ([], [])
            for i in range(batch.num_rows):
                for side, texts in zip(sides, batch.columns[-2:], strict=True):
                    side.append(hashed(value := texts[i].as_py()))
                    size += len(value)
                if size >= SLICE or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, i + 1 - first) for c in batch.columns[:-2]), *map(pa.array, _slice_counts(*sides))], names=[*keys, *COUNTS])
                    first, size, sides = i + 1, 0, ([], [])

    return kept.mapInArrow(run, ", ".join([*(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} long" for c in COUNTS)]))


def bleu(rows: DataFrame, key: str, candidate: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, bleu): sentence BLEU of up to 4-grams. Orders without a match count 1 / (2^j * 5 / ln c) matches, for the j-th such order and c > 1 words of the
    candidate; 0 without a common word. Rows with a null side are left out; an empty side gives 0."""
    kept = rows.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull())
    wide = _wide(_counted(kept, [key], candidate, reference, (1, 2, 3, 4)), [key])
    c, r = F.col("n_candidate1"), F.col("n_reference1")
    zeros = F.lit(0)
    logs = F.lit(0.0)
    for n in (1, 2, 3, 4):
        own, total = F.col(f"matched{n}"), F.greatest(F.lit(1), F.col(f"n_candidate{n}"))
        zeros = zeros + F.when(own == 0, 1).otherwise(0)
        smoothed = 1 / (F.pow(F.lit(2.0), zeros) * 5 / F.ln(c))
        logs = logs + F.ln(F.when(own > 0, own.cast("double")).otherwise(smoothed) / total) / 4
    penalty = F.when(c > r, 1.0).otherwise(F.exp(1 - r / c))
    score = F.when((F.col("matched1") == 0) | ((c <= 1) & (F.col("matched2") == 0)), 0.0).otherwise(penalty * F.exp(logs))
    return wide.select(key, F.coalesce(F.round(score, 6), F.lit(0.0)).alias("bleu"))


def corpus_bleu(rows: DataFrame, group: str, key: str, candidate: str = "prediction", reference: str = "reference", split: Callable[[Column], Column] = text.plain_words) -> DataFrame:
    """(group, bleu_1 to bleu_4): n-gram counts and lengths are summed over a group's pairs; 0 where an order up to k has no match. Words are those that split gives."""
    return _bleu_of(pair_counts(rows, [group], candidate, reference, split).groupBy(group).agg(*[F.sum(c).alias(c) for c in COUNTS]), group)


def _bleu_of(wide: DataFrame, *keep: str) -> DataFrame:
    """(keep, bleu_1 to bleu_4) of summed COUNTS."""
    c, r = F.col("n_candidate1"), F.col("n_reference1")
    penalty = F.when(c >= r, 1.0).otherwise(F.exp(1 - r / c))
    out, logs, some = [], F.lit(0.0), F.lit(True)
    for n in (1, 2, 3, 4):
        some = some & (F.col(f"matched{n}") > 0)
        logs = logs + F.ln(F.col(f"matched{n}") / F.col(f"n_candidate{n}"))
        out.append(F.when(some, penalty * F.exp(logs / n)).otherwise(0.0).alias(f"bleu_{n}"))
    return wide.select(*keep, *out)


def rouge_n(rows: DataFrame, key: str, orders: tuple[int, ...], candidate: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, n, rouge): F-measure of the n-grams of normalised words, for each order n; 0 where a side has none."""
    kept = rows.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull())
    counted = _counted(kept, [key], candidate, reference, orders)
    held = F.collect_list(F.struct("n", "matched", "n_candidate", "n_reference"))  # a struct for each order
    each = counted.groupBy(key).agg(held.alias("held")).select(key, F.explode(F.array(*map(F.lit, orders))).alias("n"), "held")
    found = each.select(key, "n", F.get(F.filter("held", lambda x: x["n"] == F.col("n")), 0).alias("x"))
    return found.select(key, "n", F.coalesce(F.round(f1(ratio(F.col("x.matched"), F.col("x.n_reference")), ratio(F.col("x.matched"), F.col("x.n_candidate"))), 6), F.lit(0.0)).alias("rouge"))


def _stems(value: str) -> list[str]:
    low = "".join(c if c.isascii() and c.isalnum() else " " for c in value.lower())
    return [stem(w) if len(w) > 3 else w for w in low.split()]


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: bit-parallel over the shorter side."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _overlap(a: list, b: list) -> int:
    from collections import Counter

    return sum((Counter(a) & Counter(b)).values())


def stemmed_rouge(rows: DataFrame, key: str, candidate: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, rouge1, rouge2, rougel): F-measures over stemmed words. A stemmer has no SQL form, so texts go to Python in Arrow batches; rows with a null side are left out."""

    def f(hit: int, a: int, b: int) -> float:
        return 2 * hit / (a + b) if hit else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                a, b = _stems(x.as_py()), _stems(y.as_py())
                p, q = list(zip(a, a[1:], strict=False)), list(zip(b, b[1:], strict=False))
                out.append((f(_overlap(a, b), len(a), len(b)), f(_overlap(p, q), len(p), len(q)), f(_common(a, b), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([round(o[i], 6) for o in out], pa.float64()) for i in range(3))], names=[key, "rouge1", "rouge2", "rougel"])

    kept = rows.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull()).select(key, candidate, reference)
    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, rouge1 double, rouge2 double, rougel double")


def word_groups(rows: DataFrame, key: str, synonyms: DataFrame) -> DataFrame:
    """(key, groups): of the words in the arrays a and b of rows, those that a table (word, group) has, each with its first group by name. Each pair's different words alone meet the table."""
    known = synonyms.select(text.normalise(F.col("word")).alias("word"), "group").dropna().groupBy("word").agg(F.min("group").alias("group"))
    each = rows.select(key, F.explode(F.array_union("a", "b")).alias("word")).join(known, "word")
    return each.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "group"))).alias("groups"))


def alignment_scores(rows: DataFrame, key: str, candidate: str = "prediction", reference: str = "reference", beta: float = 1.2, synonyms: DataFrame | None = None, split: Callable[[Column], Column] = text.plain_words) -> DataFrame:
    """(key, rouge_l, meteor): F with a weight beta on recall of the longest common subsequence, and METEOR by words, stems and the groups of a table synonyms (word, group); over the words that split
    gives, text.plain_words or text.treebank. Rows with a null side are left out; an empty side gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y, g in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                a, b = x.as_py(), y.as_py()
                n = _common(a, b) if a and b else 0
                p, r = (n / len(a), n / len(b)) if n else (0.0, 0.0)
                out.append(((1 + beta**2) * p * r / (r + beta**2 * p) if n else 0.0, meteor(a, b, dict(g.as_py() or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(o[0], 6) for o in out], pa.float64()), pa.array([round(o[1], 6) for o in out], pa.float64())], names=[key, "rouge_l", "meteor"])

    kept = rows.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull()).select(key, split(F.col(candidate)).alias("a"), split(F.col(reference)).alias("b"))
    if synonyms is None:
        kept = kept.withColumn("groups", F.lit(None).cast("map<string,string>"))
    else:
        kept = kept.join(word_groups(kept, key, synonyms.withColumn("group", F.col("group").cast("string"))), key, "left").select(key, "a", "b", "groups")
    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, rouge_l double, meteor double")


def cider_d(rows: DataFrame, group: str, key: str, candidate: str = "prediction", reference: str = "reference", sigma: float = 6.0, split: Callable[[Column], Column] = text.plain_words) -> DataFrame:
    """(key, cider): ten times the mean over 1- to 4-grams of the clipped cosine of TF-IDF vectors, with a Gaussian penalty on the difference of lengths.
    A gram's document frequency counts the group's references that have it."""
    kept = rows.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull()).select(group, key, candidate, reference)
    orders = (1, 2, 3, 4)
    met = bags(kept, [group, key], candidate, reference, orders, split).filter("n > 0")
    seen = met.groupBy(group, "n", "gram").agg(F.count_if(F.col("r") > 0).alias("df"))
    pairs = kept.groupBy(group).agg(F.count("*").alias("pairs"))
    idf = F.ln(F.col("pairs").cast("double")) - F.ln(F.greatest(F.lit(1), F.col("df")).cast("double"))
    v = met.join(seen, [group, "n", "gram"]).join(pairs, group).withColumn("w", idf)
    x, y = F.col("c") * F.col("w"), F.col("r") * F.col("w")
    sums = v.groupBy(key, "n").agg(F.sum(F.least(x, y) * y).alias("dot"), F.sqrt(F.sum(x * x)).alias("nx"), F.sqrt(F.sum(y * y)).alias("ny"))
    lengths = kept.select(key, F.exp(-F.pow(F.size(split(F.col(candidate))) - F.size(split(F.col(reference))), 2) / F.lit(2 * sigma**2)).alias("penalty"))
    cosine = F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("dot") / (F.col("nx") * F.col("ny"))).otherwise(0.0)
    own = sums.groupBy(key).agg((F.sum(cosine) / len(orders)).alias("cosine"))
    return lengths.join(own, key, "left").select(key, F.round(10 * F.coalesce("cosine", F.lit(0.0)) * F.col("penalty"), 6).alias("cider"))


#: Pairs of a group up to which its document frequencies are taken beside its pairs; those of larger groups are counted as rows, by cider_d.
GROUP = 512


def _places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted ones stand among the known, which are sorted, and which of them do."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _slice_cider(a: list[np.ndarray], b: list[np.ndarray], group: np.ndarray, sigma: float = 6.0) -> np.ndarray:
    """cider_d of pairs of hashed words, of groups that are whole."""
    rows = len(a)
    lengths = [np.array([len(x) for x in side]) for side in (a, b)]
    pairs = np.log(np.bincount(group))[group]
    flat = [(np.concatenate(side), np.repeat(np.arange(rows), n)) for side, n in zip((a, b), lengths, strict=True)]
    cosine = np.zeros(rows)
    for (x, x_row), (x_group, _), (y, y_row), (y_group, _) in zip(*(_gram_hashes(*f, mix) for f in flat for mix in (None, group)), strict=True):
        x, x_at, c = np.unique(x, return_index=True, return_counts=True)
        y, y_at, r = np.unique(y, return_index=True, return_counts=True)
        x_row, y_row = x_row[x_at], y_row[y_at]
        known, df = np.unique(y_group[y_at], return_counts=True)
        weight = lambda grams, row: pairs[row] - np.log(np.where((p := _places(known, grams))[1], df[p[0]] if len(df) else 1, 1))  # noqa: E731, B023
        u, v = c * weight(x_group[x_at], x_row), r * weight(y_group[y_at], y_row)
        at, met = _places(y, x)
        both = v[at[met]]
        dot = np.bincount(x_row[met], np.minimum(u[met], both) * both, rows)
        norm = np.sqrt(np.bincount(x_row, u * u, rows)) * np.sqrt(np.bincount(y_row, v * v, rows))
        cosine += np.divide(dot, norm, out=np.zeros(rows), where=norm > 0)
    return np.round(10 * cosine / len(ORDERS) * np.exp(-((lengths[0] - lengths[1]) ** 2) / (2 * sigma**2)), 6)


def _suite(names: list[str], beta: float = 1.2) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by group (group, whole, groups of synonyms, a, b, sim) to names: group, rouge_l, meteor, cider, sim, COUNTS. Pairs that aren't whole have no scores, those of groups of over GROUP pairs no cider."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[int, int], tuple[float, float]] = {}
        held, size, last, many = [], 0, None, 0

        def aligned(a: list[str], b: list[str], groups) -> tuple[float, float]:
            pair = hash(tuple(a)), hash(tuple(b))  # a pair comes again at each threshold
            if pair not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                n = _common(a, b) if a and b else 0
                p, r = (n / len(a), n / len(b)) if n else (0.0, 0.0)
                memo[pair] = round((1 + beta**2) * p * r / (r + beta**2 * p) if n else 0.0, 6), round(meteor(a, b, dict(groups or ())), 6)
            return memo[pair]

        def told(large_last: bool) -> pa.RecordBatch:
            number: dict = {}
            group = np.array([number.setdefault(h[0], len(number)) for h in held])
            sides = [[np.fromiter(map(hash, h[k]), np.int64, len(h[k])).view(np.uint64) for h in held] for k in (3, 4)]
            scores = [aligned(h[3], h[4], h[2]) if h[1] else (None, None) for h in held]
            cider: list[float | None] = [None] * len(held)
            some = [i for i, h in enumerate(held) if h[1] and not (large_last and h[0] == last)]
            if some:
                for i, x in zip(some, _slice_cider(*([side[i] for i in some] for side in sides), group[some]).tolist(), strict=True):
                    cider[i] = x
            columns = [*(pa.array(c, pa.float64()) for c in (*zip(*scores, strict=True), cider, [h[5] for h in held])), *map(pa.array, _slice_counts(*sides))]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], kind), *columns], names=names)

        for batch in batches:
            kind = batch.schema[0].type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    if held and (size >= SLICE or many > GROUP):
                        yield told(many > GROUP)
                        held, size = [], 0
                    last, many = row[0], 0
                elif many > GROUP and held and size >= SLICE:
                    yield told(True)
                    held, size = [], 0
                many += row[1]
                held.append(row)
                size += 8 * (len(row[3]) + len(row[4]))
        if held:
            yield told(many > GROUP)

    return run


def caption_suite(rows: DataFrame, group: str, key: str, similarity: Callable[[Column, Column], Column] | None = None, split: Callable[[Column], Column] = text.plain_words, synonyms: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """(group, bleu_1 to bleu_4, rouge_l, meteor, cider, sim): corpus BLEU of a group's pairs, and means of the others over them. Words are those that split gives: text.plain_words, or text.treebank.
    synonyms is a table (word, group) for METEOR. placed: each group's rows are in one partition already.

    Rows are shuffled by group and scored there, all scores at once; frequencies of groups of over GROUP pairs are counted as rows, spread by n-gram."""
    whole = F.col("prediction").isNotNull() & F.col("reference").isNotNull()
    large = rows.filter(whole).groupBy(group).agg(F.count("*").alias("pairs")).filter(F.col("pairs") > GROUP).select(group)
    of_large = cider_d(rows.join(large, group, "left_semi"), group, key, split=split).join(rows.select(key, group), key).groupBy(group).agg(F.avg("cider").alias("large_cider"))
    near = rows if placed else _by_key(rows, [group])
    alike = F.when(whole, (similarity or hashed_similarity)(F.col("prediction"), F.col("reference")))
    words = [split(F.col(c)).alias(side) for c, side in (("prediction", "a"), ("reference", "b"))]
    if synonyms is None:
        told = near.select(group, alike.cast("double").alias("sim"), whole.alias("whole"), F.lit(None).cast("map<string,string>").alias("groups"), *words)
    else:
        known = word_groups(rows.filter(whole).select(key, *words), key, synonyms.withColumn("group", F.col("group").cast("string")))
        told = _by_key(rows.join(known, key, "left"), [group]).select(group, alike.cast("double").alias("sim"), whole.alias("whole"), "groups", *words)
    kind = rows.schema[group].dataType.simpleString()
    scores = ["rouge_l", "meteor", "cider", "sim"]
    each = told.select(group, "whole", "groups", "a", "b", "sim").sortWithinPartitions(group).mapInArrow(_suite([group, *scores, *COUNTS]), ", ".join([f"`{group}` {kind}", *(f"{c} double" for c in scores), *(f"{c} long" for c in COUNTS)]))
    wide = each.groupBy(group).agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.avg(c).alias(c) for c in scores])
    met = wide.join(of_large, group, "left").withColumn("cider", F.coalesce("large_cider", "cider"))
    return _bleu_of(met, group, *scores)


def document_frequency(rows: DataFrame, column: str = "reference") -> DataFrame:
    """(word, df): in how many texts each word stands."""
    return rows.select(F.explode(F.array_distinct(tokens(column))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def cider_lite(rows: DataFrame, key: str, candidate: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, cider): overlap of 4-gram bags, each gram weighted 1 / (1 + df of its first word; 1 if unknown): the sum of the smaller counts over that of the larger."""
    kept = rows.filter(F.col(candidate).isNotNull() & F.col(reference).isNotNull())
    df = document_frequency(kept, reference).select(F.xxhash64("word").alias("word"), "df")
    held = _by_key(kept.select(key, candidate, reference), [key]).select(key, _hashed(candidate).alias("a"), _hashed(reference).alias("b"))
    grams = lambda words, side: F.transform(F.sequence(F.lit(0), F.size(words) - 4), lambda i: F.struct(F.get(words, i).alias("word"), F.xxhash64(*[F.get(words, i + j) for j in range(4)]).alias("gram"), F.lit(side).alias("side")))
    some = lambda words, side: F.when(F.size(words) >= 4, grams(words, side)).otherwise(F.array().cast("array<struct<word:bigint,gram:bigint,side:int>>"))
    # a row without a word, so that texts without grams are there
    none = F.array(F.struct(F.lit(None).cast("long").alias("word"), F.lit(0).cast("long").alias("gram"), F.lit(0).alias("side")))
    each = held.select(key, F.inline(F.concat(none, some(F.col("a"), 0), some(F.col("b"), 1))))
    met = each.groupBy(key, "word", "gram").agg(F.sum(1 - F.col("side")).alias("c"), F.sum("side").alias("r"))
    # counts of a first word's grams are summed before the words meet their frequencies
    by_word = met.groupBy(key, "word").agg(F.sum(F.least("c", "r")).alias("low"), F.sum(F.greatest("c", "r")).alias("high"))
    weighed = by_word.join(df, "word", "left").withColumn("w", F.when(F.col("word").isNotNull(), 1.0 / (1 + F.coalesce("df", F.lit(1)))).otherwise(0.0))
    return weighed.groupBy(key).agg(F.round(F.coalesce(ratio(F.sum(F.col("low") * F.col("w")), F.sum(F.col("high") * F.col("w"))), F.lit(0.0)), 6).alias("cider"))


def scene_scores(rows: DataFrame, key: str, column: str = "prediction") -> DataFrame:
    return rows.select(key, F.round(text.scene_score(F.col(column)), 6).alias("score"))


def score_summary(rows: DataFrame, score: str) -> DataFrame:
    """One row: mean, sample standard deviation (0 below two scores) and number."""
    return rows.agg(F.coalesce(F.round(F.avg(score), 5), F.lit(0.0)).alias("mean"), F.coalesce(F.round(F.stddev_samp(score), 5), F.lit(0.0)).alias("std"), F.count(score).alias("num_evaluated"))


def hashed_similarity(a: Column, b: Column) -> Column:
    """A stand-in for sentence embeddings: the cosine of both texts' word sets."""
    p, q = F.array_distinct(text.words(text.normalise(a))), F.array_distinct(text.words(text.normalise(b)))
    return ratio(F.size(F.array_intersect(p, q)), F.sqrt(F.size(p) * F.size(q)))
