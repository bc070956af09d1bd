"""Operator 6: token counts with a whole-token shortcut, for a BPE model of the sentencepiece library.

A text is cut into pre-tokens, at places over which no piece of the vocabulary reaches: before a run of spaces that follows another
character, and on both sides of a line feed. That no piece reaches over them is checked against the vocabulary when the model is
loaded. Merges of one pre-token then never depend on another, so the counts add up.

Offline, once on the driver, each vocabulary string is encoded alone; those that give one token are whole tokens, and tasks get their list. A pre-token among them counts 1 without
any merge. Only the rest is merged, by the library, each distinct pre-token of a task once while the cache (CACHED entries) lasts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Merged pre-tokens that are kept, and the longest of them; the cache starts afresh when it is full, which changes no count.
CACHED, LONGEST_CACHED = 200_000, 64
#: How the library writes a space; such a character in a text counts as one.
MARK = "▁"


class PieceCounter:
    """whole: the whole tokens, if they have been proved before."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: Whether pre-tokens may be counted apart; if not, every text is counted whole.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces) and self._plain_spaces()
        strings = [p.replace(MARK, " ") for p in pieces] if self.apart else []
        #: Pre-tokens that the library encodes as one token, proved one by one.
        self.whole = dict.fromkeys(whole if whole is not None else [s for s in strings if self._merged(s) == 1], 1)
        self.known: dict[str, int] = {}

    def _plain_spaces(self) -> bool:
        """The model puts one space before a text, keeps all others, and changes no character."""
        probe = "  a\n b ﬁ Ａ "
        return self.model.decode(self.model.encode(probe)) == probe and self.model.encode("a", out_type=str) == [MARK + "a"] and len(self.model.encode("\n")) == 2

    def _merged(self, pre_token: str) -> int:
        """Tokens of a pre-token. The library puts a space before a text; behind a line feed, nothing comes before a pre-token without one."""
        if pre_token.startswith(" "):
            return len(self.model.encode(pre_token[1:])) if len(pre_token) > 1 else len(self.model.encode("\n")) - 1
        return len(self.model.encode("\n" + pre_token)) - 2

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.apart or "\0" in text:
            return len(self.model.encode(text))
        text = " " + text.replace(MARK, " ")
        total, whole, known = 0, self.whole.get, self.known
        rest = []
        for line in text.split("\n"):
            # runs of spaces belong to what follows them; a run at the end of a line stands alone
            words = PRE_TOKENS(line)
            hits = [whole(w) for w in words]
            n = hits.count(1)
            total += n
            if n < len(words):
                rest += [w for w, hit in zip(words, hits, strict=True) if not hit]
        for w in rest:
            n = known.get(w)
            if n is None:
                n = self._merged(w)
                if len(w) <= LONGEST_CACHED:
                    if len(known) >= CACHED:
                        known.clear()
                    known[w] = n
            total += n
        return total + text.count("\n") * self.line_feed

    @property
    def line_feed(self) -> int:
        if not hasattr(self, "_line_feed"):
            self._line_feed = len(self.model.encode("\n")) - 1
        return self._line_feed


PRE_TOKENS = re.compile(r" *[^ ]+| +").findall


_counters: dict[str, PieceCounter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> PieceCounter:
    """One for each process and file."""
    if path not in _counters:
        _counters[path] = PieceCounter(path, whole)
    return _counters[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: the id column, n_bytes long (UTF-8), n_tokens long, over_limit boolean (more tokens than limit).

    A null text counts as empty, with no bytes and no tokens. Repeated rows give repeated results; other columns are ignored.
    """

    proved = docs.sparkSession.sparkContext.broadcast(frozenset(counter(model).whole))  # the vocabulary's strings at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model, proved.value).count
        for batch in batches:
            counts = [count(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=[id_column, "n_bytes", "n_tokens"])

    plain = docs.select(F.col(id_column), F.octet_length(F.coalesce(F.col(text_column), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_column).alias("text"))
    counted = plain.mapInArrow(run, f"`{id_column}` {plain.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
