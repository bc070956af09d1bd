"""Operator 1: document fingerprints by invertible Bloom lookup tables, by Spark's own functions alone.

A text's paragraphs (its lines, cut further after sentences and clauses, since many texts have few lines) are hashed to 64-bit digests. A table has TABLES parts of equal numbers of
cells; a digest falls into one cell of each part, which holds the number of its digests, their XOR, and the XOR of their check hashes. The
fingerprint is the table of BASE cells a part, written out.

To compare two versions, their tables of a common size are subtracted: what both hold cancels out. A cell with one digest left is pure and
names it; taking that digest out of its other cells makes more cells pure, until the digests that differ are all recovered.

The two fingerprints themselves are subtracted first. Their counts tell about how many digests differ; where BASE cells can hold as many, they are
peeled. Where they can't, that is a failure seen beforehand, and larger tables are made, sized by what the counts have told. If digests are left
in these, tables for all digests are made, and then again LARGER times as large, each time with other places.

Entries are summed to cells, and peeled, by aggregations in whole-stage code. All rows of a document stay in the partition to which the
one shuffle has brought its text and the next document's; a peeling step is an explode and an aggregation there and moves nothing.
Peeling goes through the parts in turn: within one part a digest has one cell, so no digest is taken out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import partitions, settings, written

#: Ends of paragraphs: line feeds, and white space after the end of a sentence or clause.
BREAK = r"\n+|(?<=[.!?;:,])\s+"
TABLES, BASE = 3, 8
#: Digests that differ which BASE cells a part are trusted with; cells for each digest of larger tables, and how much an estimate is raised (by 12 digests more), so that about one comparison in a hundred fails; peeling steps (each of one part).
TRUSTED, LOAD, RAISED, STEPS = 8, 2.0, 2.5, 15
#: How much larger the tables are when a comparison is tried again, and how often they grow; cells of a part at least, where it isn't BASE; documents of a partition that are tried again, about.
LARGER, GROWTH, SMALLEST, AGAIN_ROWS = 4.0, 4, 16, 512
#: Ranges of ids by quantiles at most, documents of a range, about, and ranges in all, about, from which on these hold more documents; an id of more than this part of all rows is cut by texts.
RANGES, RANGE_ROWS, MOST_RANGES, HEAVY = 512, 256, 200_000, 1000
#: Partitions against the session's number for shuffles: a document's cells are many times its text.
FINER = 4


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; a text without any has none."""
    pieces = F.filter(F.split(text, BREAK, -1), lambda p: F.length(F.btrim(p)) > 0)
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def place(digest: Column, part: int, size: Column) -> Column:
    """The digest's cell in a part of so many cells; for each size another."""
    return F.pmod(F.xxhash64(digest, F.lit(part), size), size).cast("int")


def table(held: Column, size: int = BASE) -> Column:
    """A table of size cells a part: an array of (count, key, check)."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("count"), zero.alias("key"), zero.alias("check"))
    add = lambda s, e: F.struct((s["count"] + 1).alias("count"), s["key"].bitwiseXOR(e["d"]).alias("key"), s["check"].bitwiseXOR(e["c"]).alias("check"))

    def cells(part: int) -> Column:
        at = F.transform(held, lambda d: F.struct(place(d, part, F.lit(size)).alias("i"), d.alias("d"), F.xxhash64(d).alias("c")))
        return _let(at, lambda all_at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(all_at, lambda e: e["i"] == i), start, add)))

    return F.concat(*[cells(part) for part in range(TABLES)])


def table_text(cells: Column) -> Column:
    """A table written out: for each cell the count, and key and check in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", c["count"], F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"])))), "-")


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda s, t: F.struct((s["count"] - t["count"]).alias("count"), s["key"].bitwiseXOR(t["key"]).alias("key"), s["check"].bitwiseXOR(t["check"]).alias("check")))


def differing(cells: Column, size: int = BASE) -> Column:
    """About how many digests a subtracted table holds: each cell's count is a sum of as many signs, whose squares add up to their number, but for what the two sides' sizes differ by."""
    zero = F.lit(0).cast("long")
    sums = lambda part: F.aggregate(F.slice(cells, part * size + 1, size), F.struct(zero.alias("all"), zero.alias("squares")), lambda s, c: F.struct((s["all"] + c["count"]).alias("all"), (s["squares"] + c["count"] * c["count"]).alias("squares")), lambda s: F.greatest(s["squares"] - s["all"] * s["all"] / size, F.lit(0.0)) * size / (size - 1))
    used = F.size(F.filter(cells, lambda c: (c["count"] != 0) | (c["key"] != 0))) / TABLES
    return F.greatest(used, sum((sums(part) for part in range(TABLES)), F.lit(0.0)) / TABLES)


# ---- the next document ----


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id long, text, a) with bucket, sub, n (the row's number there) and next_text and x: text and a of the next document by descending id, and of the first for the last.

    Ids are dealt to ranges, and an id of very many rows (or null) further by the texts' hashes; the first documents of each range are also sent to the range before, so every row finds
    its next within its own. Null ids come last; rows with equal ids are in the order of their texts' hashes. Only range bounds and first ids come to the driver.
    """
    spark = docs.sparkSession
    total, low, high = docs.agg(F.count("*"), F.min("id"), F.max("id")).first()
    heavy = {r.id: -(-r["count"] // max(RANGE_ROWS, total // MOST_RANGES)) for r in docs.groupBy("id").count().filter(F.col("count") > max(RANGE_ROWS, total // HEAVY)).collect()}  # HEAVY rows at most
    wanted = max(1, min(RANGES, max(4 * FINER * partitions(spark), total // RANGE_ROWS)))
    cuts = set(docs.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 10 * RANGES)).first()[0] or []) if wanted > 1 and low is not None else set()
    cuts = sorted(cuts | {c for i in heavy if i is not None for c in (i, i + 1) if c <= high})
    inner = max(1, -(-total // (max(RANGE_ROWS, total // MOST_RANGES) * (len(cuts) + 1))))  # each range is cut evenly when there are more rows than RANGES can hold
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    quantile = F.size(F.filter(bounds, lambda b: b <= F.col("id")))
    edges = [low if low is not None else 0, *cuts, (high if high is not None else 0) + 1]
    starts, widths = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ([*edges[:-1]], [max(1, b - a) for a, b in zip(edges, edges[1:], strict=False)]))
    inside = F.least(F.lit(inner - 1), F.greatest(F.lit(0), F.floor((F.col("id") - F.get(starts, quantile)) / F.get(widths, quantile) * inner)))
    bucket = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(quantile * inner + inside).cast("long")
    parts = F.lit(heavy.get(None, 1))
    for i, n in heavy.items():
        parts = parts if i is None else F.when(F.col("id") == i, F.lit(n)).otherwise(parts)
    parts = F.when(F.col("id").isNull() | F.col("id").isin([i for i in heavy if i is not None]), parts).otherwise(1)
    sub = F.least(parts - 1, F.floor((F.col("h") / 2.0**64 + 0.5) * parts)).cast("long")
    ranged = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket).withColumn("sub", sub)
    first = F.min(F.struct(F.bitwise_not("id").alias("down"), F.col("h")))
    firsts = sorted(((-r.bucket, r.sub, r.first.down, r.first.h) for r in ranged.groupBy("bucket", "sub").agg(first.alias("first")).collect()), key=lambda r: r[:2])  # a row for each range
    before = [(-bucket, sub, down, h, -firsts[i - 1][0], firsts[i - 1][1]) for i, (bucket, sub, down, h) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "head_bucket long, head_sub long, down long, head_h long, to_bucket long, to_sub long"))
    joined = ranged.join(heads, (F.col("bucket") == F.col("head_bucket")) & (F.col("sub") == F.col("head_sub")) & F.bitwise_not("id").eqNullSafe(F.col("down")) & (F.col("h") == F.col("head_h")), "left")
    own = F.struct(F.col("bucket").alias("b"), F.col("sub").alias("s"), F.lit(0).alias("sent"))
    sent = F.struct(F.col("to_bucket").alias("b"), F.col("to_sub").alias("s"), F.lit(1).alias("sent"))
    dealt = joined.select("id", "text", "a", "h", F.explode(F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, sent))).alias("x"))
    dealt = dealt.select("id", "text", "a", "h", F.col("x.b").alias("bucket"), F.col("x.s").alias("sub"), F.col("x.sent").alias("sent"))
    dealt = dealt.repartition(FINER * partitions(spark), "bucket", "sub")
    order = Window.partitionBy("bucket", "sub").orderBy("sent", F.desc_nulls_last("id"), "h", "text")
    return dealt.withColumns({"n": F.row_number().over(order), "next_text": F.lead("text").over(order), "x": F.lead("a").over(order)}).filter("sent = 0").drop("sent", "h")


# ---- comparing ----


KEYS = ["bucket", "sub", "n"]


def _entries(pairs: list[tuple[str, str]], attempt: int) -> Column:
    """For each pair of two columns of digests: their subtracted fingerprints' cells where these are to be peeled, and else an entry for each digest, with the size of its table.

    The columns of a pair's second one, say e, go with cells_e (the subtracted fingerprints) and about_e (how many digests are thought to differ)."""
    zero, none = F.lit(0).cast("long"), F.lit(-1)
    entry = lambda pair, size, sign, d, cell, count, key, check: F.struct(F.lit(pair).alias("pair"), size.cast("int").alias("size"), F.lit(sign).alias("sign"), d.alias("d"), cell.cast("int").alias("cell"), count.alias("count"), key.alias("key"), check.alias("check"))
    out = []
    for pair, (a, b) in enumerate(pairs):
        both = F.size(a) + F.size(b)
        wanted = F.least(both, F.col(f"about_{b}") * RAISED + 12) if attempt == 0 else both
        size = (F.greatest(F.lit(SMALLEST), F.ceil(wanted * (LOAD * LARGER ** min(attempt, GROWTH)) / TABLES)) + attempt).cast("int")
        digests_of = lambda held, sign: F.transform(held, lambda d: entry(pair, size, sign, d, none, zero, zero, zero))  # noqa: E731, B023
        large = F.concat(digests_of(a, 1), digests_of(b, -1))
        if attempt == 0:
            base = F.transform(f"cells_{b}", lambda c, i: entry(pair, F.lit(BASE), 1, zero, i, c["count"], c["key"], c["check"]))  # noqa: B023
            large = F.when(F.col(f"about_{b}") <= TRUSTED, base).otherwise(large)
        out.append(large)
    return F.concat(*out)


def _summed(cells: DataFrame) -> DataFrame:
    summed = cells.groupBy(*KEYS, "pair", "size", "cell").agg(F.sum("count").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return summed.filter("cell < 0 or count <> 0 or key <> 0")


def peeled(rows: DataFrame, pairs: list[tuple[str, str]], attempt: int = 0, steps: int = STEPS) -> DataFrame:
    """(bucket, sub, n, pair, only_a, only_b, left) for rows (bucket, sub, n, arrays of digests and what _entries needs): how many digests only one of a pair's arrays has, as far as they
    were recovered, and how many cells are left. A pair without a difference has no row."""
    entries = rows.select(*KEYS, F.explode(_entries(pairs, attempt)).alias("e")).select(*KEYS, "e.*")
    cell = lambda d, part: F.col("size") * part + place(d, part, F.col("size"))
    item = lambda c, n, key, check: F.struct(c.cast("int").alias("cell"), n.cast("long").alias("count"), key.alias("key"), check.alias("check"))
    each = F.array(*[item(cell(F.col("d"), part), F.col("sign"), F.col("d"), F.xxhash64("d")) for part in range(TABLES)])
    ready = F.array(item(F.col("cell"), F.col("count"), F.col("key"), F.col("check")))
    cells = entries.select(*KEYS, "pair", "size", F.explode(F.when(F.col("cell") >= 0, ready).otherwise(each)).alias("c"))
    cells = _summed(cells.select(*KEYS, "pair", "size", "c.*"))
    for step in range(steps):
        part = step % TABLES
        here = (F.col("cell") >= F.col("size") * part) & (F.col("cell") < F.col("size") * (part + 1))
        pure = here & (F.abs("count") == 1) & (F.xxhash64("key") == F.col("check"))
        zero = F.lit(0).cast("long")
        tally = item(F.when(F.col("count") > 0, F.lit(-1)).otherwise(F.lit(-2)), F.lit(1), zero, zero)
        out = [item(cell(F.col("key"), other), -F.col("count"), F.col("key"), F.col("check")) for other in range(TABLES) if other != part]
        kept = item(F.col("cell"), F.col("count"), F.col("key"), F.col("check"))
        cells = cells.select(*KEYS, "pair", "size", F.explode(F.when(pure, F.array(tally, *out)).otherwise(F.array(kept))).alias("c"))
        cells = _summed(cells.select(*KEYS, "pair", "size", "c.*"))
    count = lambda which: F.sum(F.when(which, F.col("count")).otherwise(0))
    return cells.groupBy(*KEYS, "pair").agg(count(F.col("cell") == -1).alias("only_a"), count(F.col("cell") == -2).alias("only_b"), F.sum((F.col("cell") >= 0).cast("long")).alias("left"))


def _let(value: Column, body) -> Column:
    """body(value) with value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(n_a: Column, n_b: Column, only_a: Column, only_b: Column) -> Column:
    """Share of both versions' distinct digests that both have; 1 for two empty ones."""
    either = n_b + only_a
    return F.when(either <= 0, F.lit(1.0)).otherwise((n_a - only_a) / either)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", steps: int = STEPS) -> DataFrame:
    """Per row of docs: id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double, attempts int.

    The edited text has its last n_chars / 3 (rounded down) code points replaced by as many from the start of the next document (or all
    that it has), by descending id; the last document's next is the first, and a lone document's is itself. A null text is empty. Null ids come after all others; rows with equal ids
    are in the order of their texts' hashes, repeated rows follow each other. An empty table gives no rows. Ids are integers; other columns may have any names.
    attempts is 1 where the fingerprints, or tables sized by them, gave all that differs.
    """
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    base = base.withColumn("a", digests(F.col("text")))
    zero = F.lit(0).cast("long")
    rows = with_next(base) if not base.isEmpty() else base.select("id", "text", "a", zero.alias("bucket"), zero.alias("sub"), F.lit(1).alias("n"), F.col("text").alias("next_text"), F.col("a").alias("x"))
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("e", digests(F.col("edited"))).withColumns({f"table_{c}": table(F.col(c)) for c in "aex"})
    rows = rows.withColumns({f"cells_{c}": subtracted(F.col("table_a"), F.col(f"table_{c}")) for c in "ex"})
    rows = rows.withColumns({f"about_{c}": differing(F.col(f"cells_{c}")) for c in "ex"})
    info = rows.select(
        *KEYS, F.struct("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), table_text(F.col("table_a")).alias("own"), table_text(F.col("table_e")).alias("other")).alias("info"), "a", "e", "x", "cells_e", "cells_x", "about_e", "about_x",
    )
    done: DataFrame | None = None
    attempt = 0
    left, spark = None, docs.sparkSession
    while left != 0:
        # each aggregation's first-level map takes a whole page of memory from the start, which a chain of thirty hasn't to spare; and the few that are tried again aren't worth
        # compiling another chain
        with settings(spark, spark__sql__codegen__aggregate__map__twolevel__enabled="false", spark__sql__codegen__wholeStage=str(attempt == 0).lower(), spark__sql__parquet__compression__codec="zstd"):
            found = written(_compared(info, attempt, steps if attempt == 0 else STEPS), "fingerprints")
        over = found.filter("left_e = 0 and left_x = 0")
        done = over if done is None else done.union(over)
        again = found.filter("left_e > 0 or left_x > 0")
        left = again.count()
        # dealt as before, so that peeling moves nothing, but to as few partitions as will do
        info = again.select(*KEYS, "info", "a", "e", "x").repartition(max(1, min(FINER * partitions(spark), -(-left // AGAIN_ROWS))), *KEYS)
        attempt += 1
    return done.select(
        F.col("info.id").alias(id_column), "info.n_chars", F.col("info.sha").alias("edited_sha256"), F.col("info.own").alias("fingerprint"), F.col("info.other").alias("edited_fingerprint"), "near_edited", "near_next", "attempts",
    )


def _compared(info: DataFrame, attempt: int, steps: int) -> DataFrame:
    """info (bucket, sub, n, info, the digests a, e and x, and at first what _entries needs) with what comparing a with e and with x has given; the digests stay where cells are left."""
    found = peeled(info, [("a", "e"), ("a", "x")], attempt, steps)
    names = [f"{c}_{other}" for other in "ex" for c in ("only_a", "only_b", "left")]
    arrays = ("a", "e", "x")
    facts = info.select(*KEYS, "info", *arrays, *[F.lit(None).cast("long").alias(c) for c in names])
    # each document's facts and its pairs' numbers meet in the partition where they are
    numbers = found.select(*KEYS, F.lit(None).cast(info.schema["info"].dataType).alias("info"), *[F.lit(None).cast("array<long>").alias(c) for c in arrays], *[F.when(F.col("pair") == p, F.col(c)).alias(f"{c}_{other}") for p, other in enumerate("ex") for c in ("only_a", "only_b", "left")])
    met = facts.union(numbers).groupBy(*KEYS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("info", *arrays)], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])
    near = lambda other: likeness(F.size("a"), F.size(other), F.col(f"only_a_{other}"), F.col(f"only_b_{other}")).cast("double")
    left = (F.col("left_e") > 0) | (F.col("left_x") > 0)
    return met.select(*KEYS, "info", "left_e", "left_x", near("e").alias("near_edited"), near("x").alias("near_next"), F.lit(attempt + 1).alias("attempts"), *[F.when(left, F.col(c)).alias(c) for c in arrays])
