"""Operator 2: secret scans with multipart credential linking, by Spark's own functions alone.

Strong patterns are reported wherever they stand. Weak ones (a bare 40-character key, an endpoint) are far too common to be reported
alone: they are joined with the access identifiers of the same text whose interval, widened by the reach on both sides, meets
theirs, and reported only where the complementary part is there: a key beside an access identifier, an endpoint beside an access
identifier that also has a secret in reach. The join is within the row, so nothing is shuffled and no text is copied. It is a merge:
spans of one kind don't overlap, so once both sides are sorted together, only a span's neighbours on the other side can meet it.

Positions are counted in code points. Spark has no function for them: the text is split at the matches, and the lengths of what lies between
and of the matches add up. The sums run over blocks of BLOCK matches, so a text of a million matches takes no quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import spare, text_or_empty

#: Kinds in their order of listing: pattern, the group whose length counts, its least length.
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),
}
#: Reported only beside their complements.
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=])", 1, 40),
    "endpoint": (r"((?i:https?|s3|wss?|postgres|mysql|redis|mongodb)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+)", 1, 8),
}
ORDER = [*STRONG, *WEAK]
#: Code points between two parts of a credential at most.
REACH = 200
BLOCK = 256
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _let(value: Column, body) -> Column:
    """body(value) with value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, kind: str) -> Column:
    """Spans of the leftmost matches that don't overlap, of which those that are too short are dropped: struct(start, rank, end), end exclusive."""
    pattern, group, least = (STRONG | WEAK)[kind]
    none = F.array().cast(SPAN)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x).cast("long"))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), own.alias("own")), lambda x: x["whole"].isNotNull())
    blocks = _let(steps, lambda own: F.transform(F.sequence(F.lit(1), F.size(own), F.lit(BLOCK)), lambda i: F.slice(own, i, F.lit(BLOCK))))
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["whole"])
    bases = lambda sums: F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def within(block: Column, base: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            begin = base + state["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), (begin + x["whole"]).alias("end"))
            return F.struct((state["at"] + x["gap"] + x["whole"]).alias("at"), F.when(x["own"] >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        return F.aggregate(block, start, step, lambda state: state["out"])

    placed = _let(blocks, lambda all_blocks: F.flatten(F.zip_with(all_blocks, bases(F.transform(all_blocks, total)), lambda block, base: F.when(block.isNotNull(), within(block, base)).otherwise(none))))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def near(spans: Column, parts: Column, reach: int, strictly: bool = False, keep: bool = True) -> Column:
    """Those of spans that meet one of parts when widened by reach on both sides (keep), or those that don't; strictly: touching isn't meeting.
    Parts are sorted and don't overlap each other, so the last one that starts before a span and the first after it decide."""
    ranked = lambda xs, side: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(side).alias("side"), x["end"].alias("end"), x["rank"].alias("rank")))

    def merged(own: Column) -> Column:
        both = F.array_sort(F.concat(ranked(own, 0), ranked(spans, 1)))
        asked = F.filter(F.transform(both, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"]["side"] == 1)

        def met(y: Column, j: Column) -> Column:
            first, last = y["x"]["start"] - reach, y["x"]["end"] + reach
            before, after = F.get(own, y["i"] - j - 1), F.get(own, y["i"] - j)
            found = (before["end"] > first, after["start"] < last) if strictly else (before["end"] >= first, after["start"] <= last)
            return F.coalesce(found[0], F.lit(False)) | F.coalesce(found[1], F.lit(False))

        told = F.transform(asked, lambda y, j: F.struct(met(y, j).alias("met"), F.struct(y["x"]["start"].alias("start"), y["x"]["rank"].alias("rank"), y["x"]["end"].alias("end")).alias("x")))
        return F.transform(F.filter(told, lambda t: t["met"] if keep else ~t["met"]), lambda t: t["x"])

    return _let(parts, merged)


def _linked(parts: dict[str, Column], reach: int) -> Column:
    access, assigned, ends = parts["access"], parts["assign"], parts["endpoint"]
    fresh = parts["key"]
    for kind in STRONG:  # a key is none where a strong span overlaps it
        fresh = near(fresh, parts[kind], 0, strictly=True, keep=False)

    def with_keys(keys: Column) -> Column:
        # a secret is a linked key or what an assignment names
        full = F.concat(near(access, keys, reach), near(near(access, keys, reach, keep=False), assigned, reach))
        return F.concat(keys, near(ends, F.array_sort(full), reach))

    return _let(near(fresh, access, reach), with_keys)


def scan(docs: DataFrame, reach: int = REACH, text_column: str = "text", name: str = "found") -> DataFrame:
    """docs with one more column: array of struct(start long, rank int, end long), by start and then rank; rank is the kind's place in ORDER.

    A null text counts as empty and has no spans. Strong spans are all there whatever is linked. Repeated rows give repeated results;
    other columns stay as they are, and name must be none of them.
    """
    columns = list(docs.columns)
    parts = {kind: spare([*columns, name], f"at_{kind}")[0] for kind in ORDER}
    text = spare([*columns, name, *parts.values()], "whole")[0]
    none = F.array().cast(SPAN)
    base = docs.withColumn(text, text_or_empty(text_column))
    base = base.withColumns({parts[kind]: matches(F.col(text), kind) for kind in STRONG})
    # weak ones matter only beside an access identifier
    base = base.withColumns({parts[kind]: F.when(F.size(parts["access"]) > 0, matches(F.col(text), kind)).otherwise(none) for kind in WEAK})
    strong = F.concat(*[F.col(parts[kind]) for kind in STRONG])
    linked = F.when(F.size(parts["access"]) > 0, _linked({kind: F.col(c) for kind, c in parts.items()}, reach)).otherwise(none)
    return base.select(*[F.col(f"`{c}`") for c in columns], F.array_sort(F.concat(strong, linked)).alias(name))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame, reach: int = REACH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_linked long, base_sha256, spans string."""
    found = scan(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), reach)
    of = lambda kind: F.filter("found", lambda s: s["rank"] == ORDER.index(kind))
    base = F.filter("found", lambda s: s["rank"] < len(STRONG))
    return found.select(
        F.col("doc_id").alias(id_column), *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in STRONG], (F.size("found") - F.size(base)).cast("long").alias("n_linked"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, reach: int = REACH, text_column: str = "text") -> DataFrame:
    """docs with each secret (and what overlaps it, as one) in the text replaced by [SECRET]; a text without any, and a null one, stays as it is."""
    found = spare(docs.columns, "found")[0]
    text = F.col(text_column)

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.array(F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("[SECRET]")))
        apart = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size(found) > 0, F.aggregate(F.col(found), start, step, end)).otherwise(text)
    return scan(docs, reach, text_column, found).select(*[clean.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
