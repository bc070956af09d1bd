"""Operator 13: chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its text is trainable. A conversation whose last turn
isn't an assistant's has one more example, which holds all of its turns and trains nothing, so that no turn is lost.

A template marks turns. Its control strings are escaped in texts and roles by a backslash behind their first character; where one or more backslashes stand
there already, one is added. No control string is left in a text then, and taking one backslash away from each such place gives the text back.

An example repeats its context, so a conversation's examples grow with the square of its turns. They are made from the conversation's turns where these are,
behind the only exchange, and streamed: what comes after them needs to keep no more than it wants. A conversation is one string and must be below Spark's 2 GB.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import text_or_empty

ASSISTANT = "assistant"


@dataclass(frozen=True)
class Template:
    """A turn is begin, role, middle, text, end; marks are made of control strings, and neither these nor their characters behind the first hold a backslash or another one's first character."""

    begin: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self):
        firsts = {c[0] for c in self.controls} | {"\\"}
        if any(len(c) < 2 or firsts & set(c[1:]) or c[0] == "\\" for c in self.controls):
            raise ValueError("control strings need two characters or more, and first characters that stand nowhere else in them")
        marks = (self.begin, self.middle, self.end)
        if any(not m or re.sub("|".join(map(re.escape, self.controls)), "", m) for m in marks) or self.begin in self.middle or self.end in self.begin + self.middle:
            raise ValueError("marks are made of control strings and differ")

    @property
    def _parts(self) -> tuple[str, str]:
        """Patterns of the first characters and of what follows them."""
        quote = lambda s: re.sub(r"([^A-Za-z0-9])", r"\\\1", s)
        return "[" + "".join(sorted({quote(c[0]) for c in self.controls})) + "]", "|".join(sorted({quote(c[1:]) for c in self.controls}))

    def escape(self, text: Column) -> Column:
        first, rest = self._parts
        return F.regexp_replace(text, rf"({first})(\\*)({rest})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        first, rest = self._parts
        return F.regexp_replace(text, rf"({first})\\(\\*)({rest})", "$1$2$3")

    def turn(self, role: Column, escaped: Column) -> Column:
        return F.concat(F.lit(self.begin), self.escape(role), F.lit(self.middle), escaped, F.lit(self.end))

    def turns(self, text: Column) -> Column:
        """array<struct<role, text>> of a formatted text."""
        pieces = F.split(text, _literal(self.end), -1)
        marked = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing stands behind the last end

        def read(piece: Column) -> Column:
            at = F.locate(self.middle, piece)
            role = F.substring(piece, F.lit(1 + len(self.begin)), at - 1 - len(self.begin))
            return F.struct(self.unescape(role).alias("role"), self.unescape(F.substring(piece, at + len(self.middle), F.length(piece))).alias("text"))

        return F.transform(marked, read)


def _literal(text: str) -> str:
    """A Java pattern for the text itself."""
    return rf"\Q{text}\E"


LLAMA = Template()


def examples(turns: DataFrame, template: Template = LLAMA, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Per example: the id column, lone long, example int (from 1), n_turns int, text string, loss_start, loss_end long (code points of text, end exclusive; both null where nothing is trained), last boolean (it holds all turns of the conversation).

    Turns are ordered by turn (a null one first), then role, then text; repeated rows are repeated turns. A null role or text is an empty one. Rows without an id belong
    to no common conversation: each different one is a conversation of its own, told apart by lone, which is null elsewhere. Other columns are ignored; an empty table gives no example.
    """
    plain = turns.select(F.col(id_column).alias("conv"), F.col(turn_column).alias("turn"), text_or_empty(role_column).alias("role"), text_or_empty(text_column).alias("text"))
    keyed = plain.withColumn("lone", F.when(F.col("conv").isNull(), F.xxhash64("turn", "role", "text")))
    held = keyed.groupBy("conv", "lone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # texts are escaped once for each turn, not once for each example
    marked = held.select("conv", "lone", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), template.escape(t["text"]).alias("text"))).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct((i + 1).alias("n"), (t["role"] == ASSISTANT).alias("trained"), F.length(t["text"]).alias("chars")))
    built = marked.select(
        "conv", "lone", F.transform("turns", lambda t: template.turn(t["role"], t["text"])).alias("segments"), F.filter(numbered, lambda t: t["trained"] | (t["n"] == F.size("turns"))).alias("targets")
    )
    each = built.select("conv", "lone", "segments", F.size("targets").alias("of"), F.posexplode("targets").alias("example", "target"))
    told = each.select("conv", "lone", (F.col("example") + 1).alias("example"), F.col("target.n").alias("n_turns"), F.array_join(F.slice("segments", F.lit(1), F.col("target.n")), "").alias("text"), "target", (F.col("example") + 1 == F.col("of")).alias("last"))
    end = F.when(F.col("target.trained"), F.length("text") - len(template.end)).cast("long")
    return told.select(F.col("conv").alias(id_column), "lone", "example", "n_turns", "text", (end - F.col("target.chars")).alias("loss_start"), end.alias("loss_end"), "last")


def read_back(made: DataFrame, template: Template = LLAMA, id_column: str = "conv_id") -> DataFrame:
    """Per conversation, from its examples alone: the id column, turns array<struct<role, text>>, loss string (all trained text, unescaped, in order), formatted_chars long (of all examples)."""
    start, end = F.col("loss_start"), F.col("loss_end")
    trained = F.when(end.isNotNull(), template.unescape(F.substring("text", (start + 1).cast("int"), (end - start).cast("int"))))
    kept = made.select(F.col(id_column).alias("conv"), "lone", "example", trained.alias("trained"), F.when(F.col("last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"))
    held = kept.groupBy("conv", "lone").agg(F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("replies"), F.first("whole", ignorenulls=True).alias("whole"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("replies", lambda r: r["trained"]), "")  # without the null of an example that trains nothing
    return held.select(F.col("conv").alias(id_column), template.turns(F.col("whole")).alias("turns"), loss.alias("loss"), "formatted_chars")


def digest(turns: DataFrame, template: Template = LLAMA, id_column: str = "conv_id") -> DataFrame:
    """Per conversation: the id column, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from its examples. Odd rows: see examples."""
    back = read_back(examples(turns, template, id_column), template, id_column)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col(id_column), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
