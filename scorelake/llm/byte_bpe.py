"""Operator 10: byte-level BPE encoding and decoding through a table of distinct words.

A text is split into words by the tokenizer's own pattern. Merges never cross a word, so a word's ids are the same
wherever it stands: each distinct word is encoded once, and the ids are joined back by the words' positions. Decoding
joins each id with the piece of bytes that it stands for.

1. Documents are dealt to blocks of some megabytes. In place of its texts, a block keeps the words' numbers, in the order of their positions; its
   distinct words are dealt to parts by a hash. Both go through one exchange, by block and by part; the texts go no further.
2. In each part, the blocks' words are sorted. Each distinct word is encoded once, and its ids go back to every block and number that asked.
3. Blocks and ids meet by block. A document's ids are gathered by its words' numbers; the ids are joined with the table of pieces, which has a row
   for each id of the vocabulary and so a bound, and the pieces' bytes are the decoded text.

So a word travels once for each block that has it and not once for each place where it stands; words, numbers and ids travel packed. Blocks are made by
a deterministic pass over the input, in the order of its partitions; a lost task makes the same ones again.

Texts with characters that versions of Unicode may class differently are split by the library's own pre-tokenizer, all others by the same pattern in
regex, which is faster.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scorelake.llm.common import partitions, settled

#: Bytes of text of a block, about; a longer text has a block of its own.
BLOCK_BYTES = 6 << 20
#: Words encoded at a time.
AT_ONCE = 8192
#: Words whose ids are packed at a time.
PACKED = 1 << 18
#: Parts of the words for each partition of an exchange; numbers of blocks begin beyond those of parts.
FINER, FIRST_BLOCK = 8, 1 << 40
#: Entries of the table of distinct words that one ByteBpe keeps for encode; it then starts afresh, which changes no result.
CACHED = 200_000
#: Longer words are encoded each time they occur in encode; the ids are the same.
LONGEST_CACHED = 64
#: Longer texts are encoded by words in encode_fast, whatever their form; the ids are the same.
LONGEST_FAST = 1_000_000
#: Characters whose class (letter, number, space, other) has been the same in all versions of Unicode since 3.0.
SETTLED = r"[^\x00-ȟΆ-ώЁ-яא-ת‐-‧‰-⁆€ぁ-ゔァ-ヺ一-龥가-힣]"


class ByteBpe:
    """Ids and bytes of texts for a tokenizer file with a byte-level pre-tokenizer and no normaliser."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.words_of = regex.compile(public_tokenizers.PATTERN).findall
        self.unsettled = regex.compile(SETTLED).search
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    @property
    def pieces(self) -> list[bytes]:
        """The bytes of each id, by id."""
        if not hasattr(self, "_pieces"):
            byte_of = {c: b for b, c in enumerate(_byte_letters())}
            by_id = [b""] * self.library.get_vocab_size()
            for piece, i in self.library.get_vocab().items():
                by_id[i] = piece.encode() if piece in self.special else bytes(byte_of[c] for c in piece)
            self._pieces = by_id
        return self._pieces

    def split(self, text: str) -> list[str]:
        """The words of a text; the string of a special token is one."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._split(text)
        return [w for x in self.at_special.split(text) if x for w in ([x] if x in self.special else self._split(x))]

    def _split(self, text: str) -> list[str]:
        if text.isascii() or not self.unsettled(text):
            return self.words_of(text)
        return [text[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    @property
    def piece_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes, and where each id's piece starts and how long it is."""
        if not hasattr(self, "_piece_table"):
            lengths = np.array([len(p) for p in self.pieces], np.int64)
            self._piece_table = np.frombuffer(b"".join(self.pieces), np.uint8), np.cumsum(lengths) - lengths, lengths
        return self._piece_table

    def learn(self, words: list[str]) -> dict[str, bytes]:
        coded = self.library.encode_batch(words, add_special_tokens=False)
        return {w: self._packed(c.ids) for w, c in zip(words, coded, strict=True)}

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens' strings, as little-endian unsigned 32-bit integers."""
        if not text.isascii() and self.unsettled(text):
            return self._packed(self.library.encode(text, add_special_tokens=False).ids)
        words = self.words_of(text)
        known = self.known
        fresh = [w for w in set(words) if w not in known]
        if not fresh:
            return b"".join([known[w] for w in words])
        learnt = self.learn(fresh)
        if len(known) + len(learnt) > CACHED:
            known.clear()
        out = b"".join([known[w] if w in known else learnt[w] for w in words]) if known else self._joined(words, learnt)
        known.update((w, ids) for w, ids in learnt.items() if len(w) <= LONGEST_CACHED)
        return out

    def _joined(self, words: list[str], learnt: dict[str, bytes]) -> bytes:
        missing = [w for w in set(words) if w not in learnt]
        table = learnt | self.learn(missing) if missing else learnt
        return b"".join([table[w] for w in words])

    def encode(self, text: str) -> bytes:
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self.at_special.split(text) if x)

    @property
    def ranked(self):
        """An encoder of the same vocabulary by ranks, or None if the file's merges aren't in the order of their results' ids."""
        if not hasattr(self, "_ranked"):
            model = json.loads(self.library.to_str())["model"]
            merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
            at = [model["vocab"].get(m) for m in merged]
            plain = len(model["vocab"]) == 256 + len(at) and at == list(range(256, 256 + len(at))) and not model.get("ignore_merges") and not model.get("dropout")
            self._ranked = None
            if plain:
                import tiktoken

                ranks = {p: i for i, p in enumerate(self.pieces[: len(model["vocab"])])}
                self._ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        return self._ranked

    def encode_fast(self, text: str) -> bytes:
        """As encode, without the table of words where the text's length and characters allow it."""
        if len(text) > LONGEST_FAST or self.ranked is None or any(s in text for s in self.special) or not text.isascii() and self.unsettled(text):
            return self.encode(text)
        return bytes(self.ranked(text, set()))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


@cache
def coder(path: str) -> ByteBpe:
    """One for each worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path)


def _joined(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    at = 8 * (n + 1)
    out = []
    for size in np.frombuffer(data, np.int64, n, 8).tolist():
        out.append(data[at : at + size])
        at += size
    return out


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent, compressed: a byte for each, and four more planes of bytes for those that don't fit in one."""
    large = numbers[numbers >= 255] - 255
    planes = [np.minimum(numbers, 255).astype(np.uint8), *((large >> (8 * i) & 255).astype(np.uint8) for i in range(4))]
    return _joined(*(_pack(p.tobytes()) for p in planes))


def _spread(data: bytes) -> np.ndarray:
    out, *planes = (np.frombuffer(_unpack(p), np.uint8).astype(np.int64) for p in _split(data))
    out[out == 255] += sum(p << (8 * i) for i, p in enumerate(planes))
    return out


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(1, int.from_bytes(data[:8], "little")))


def _rising(numbers: np.ndarray) -> bytes:
    """Rising numbers, by their steps."""
    return _squeezed(np.diff(numbers, prepend=0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_spread(data))


def coded_numbers(number: np.ndarray, n_single: int, n_words: int) -> bytes:
    """The words' numbers by position; the last n_single words stand once each, in the order of their numbers, and are all written as 0."""
    repeated = n_words - n_single
    return _squeezed(np.where(number < repeated, number + 1, 0)) + repeated.to_bytes(8, "little")


def decoded_numbers(data: bytes) -> np.ndarray:
    codes, repeated = _spread(data[:-8]), int.from_bytes(data[-8:], "little")
    single = codes == 0
    return np.where(single, repeated + np.cumsum(single) - 1, codes - 1)


def packed_words(numbers: np.ndarray, words: pa.Array) -> bytes:
    """Words with their rising numbers."""
    data = [w.encode() for w in words.to_pylist()]
    return _joined(_rising(numbers), _squeezed(np.array([len(w) for w in data], np.int64)), _pack(b"".join(data)))


def unpacked_words(data: bytes) -> tuple[np.ndarray, pa.Array]:
    numbers, lengths, letters = _split(data)
    offsets = np.concatenate([[0], np.cumsum(_spread(lengths))]).astype(np.int32)
    return _risen(numbers), pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_unpack(letters)))


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """values[starts[r] : starts[r] + lengths[r]] for each r of rows, one after the other."""
    own = lengths[rows]
    ends = np.cumsum(own)
    return values[np.repeat(starts[rows] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]


def packed_ids(numbers: np.ndarray, ids: pa.Array) -> bytes:
    """Each number's ids, by rising number."""
    flat, starts, lengths = _ids_of(ids)
    order = np.argsort(numbers, kind="stable")
    every = _gathered(flat, starts, lengths, order)
    planes = [(every >> (8 * i) & 255).astype(np.uint8) for i in range(3)]
    return _joined(_rising(numbers[order]), _squeezed(lengths[order]), *(_pack(p.tobytes()) for p in planes))


def unpacked_ids(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, how many ids each has, and all ids."""
    numbers, lengths, *planes = _split(data)
    return _risen(numbers), _spread(lengths), sum(np.frombuffer(_unpack(p), np.uint8).astype(np.uint32) << np.uint32(8 * i) for i, p in enumerate(planes))


def _ids_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of an array of packed 32-bit ones, and where each row's start and how many it has."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset).astype(np.int64) // 4
    flat = np.frombuffer(ids.buffers()[2], np.uint32, int(bounds[-1])) if ids.buffers()[2] is not None else np.zeros(0, np.uint32)
    return flat, bounds[:-1], np.diff(bounds)


ROW = ["key", "block", "ids", "counts", "data"]


def blocks(docs: DataFrame, tokenizer: str, parts: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key long, block long, ids, counts, data binary): for each block a row whose key is the block, with the ids of its rows, how many words each row's text has, and the words' numbers by position;
    and for each block and part, which is the key, a row with the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, made = coder(tokenizer), TaskContext.get().partitionId(), 0
        ids, words, counts, size = [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            own = FIRST_BLOCK + (task << 32) + made
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            number, distinct, n_single = numbered(words)
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([own]), one(pa.concat_arrays(ids)), one(pa.array(counts, pa.int64())), pa.array([coded_numbers(number, n_single, len(distinct))], pa.binary())], names=ROW)
            part = (pd.util.hash_array(np.asarray(distinct), categorize=False) % np.uint64(parts)).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
            order = np.argsort(part, kind="stable")
            keys, first = np.unique(part[order], return_index=True)
            groups = [order[at:to] for at, to in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)] if len(order) else []
            data = [packed_words(g, distinct.take(pa.array(g))) for g in groups]
            if groups:
                none = pa.nulls(len(groups))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([own] * len(groups), pa.int64()), none.cast(pa.list_(ids[0].type)), none.cast(pa.list_(pa.int64())), pa.array(data, pa.binary())], names=ROW)

        for batch in batches:
            column = batch.column(0)
            since = 0
            for i, text in enumerate(batch.column(1)):
                own = bpe.split(text.as_py() or "")
                words += own
                counts.append(len(own))
                size += sum(map(len, own))
                if size >= BLOCK_BYTES:
                    ids.append(column.slice(since, i + 1 - since))
                    yield from block()
                    made, since = made + 1, i + 1
                    ids, words, counts, size = [], [], [], 0
                    pa.default_memory_pool().release_unused()
            if since < batch.num_rows:
                ids.append(column.slice(since))
        if counts:
            yield from block()

    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"key long, block long, ids array<{plain.schema[0].dataType.simpleString()}>, counts array<long>, data binary")


def numbered(words: list[str]) -> tuple[np.ndarray, pa.Array, int]:
    """Each position's number, the words by number, and how many of these, the last, stand at one position alone: first the repeated ones by frequency, then the others in their order."""
    if not words:
        return np.zeros(0, np.int64), pa.array([], pa.string()), 0
    coded = pa.array(words, pa.string()).dictionary_encode()  # in the order in which they come
    number, distinct = np.asarray(coded.indices), coded.dictionary
    times = np.bincount(number, minlength=len(distinct))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[number], distinct.take(pa.array(order)), int((times == 1).sum())


def encoded(batches: Iterator[pa.RecordBatch], bpe: ByteBpe) -> Iterator[pa.RecordBatch]:
    """(key, data) for batches (block, number, word) sorted by word: each distinct word is encoded once. data has ids of several numbers of a block, which is the key."""
    last, known = None, b""
    blocks_of, numbers, ids = [], [], []

    def packed() -> pa.RecordBatch:
        block, number, own = np.concatenate(blocks_of), np.concatenate(numbers), pa.concat_arrays(ids)
        order = np.argsort(block, kind="stable")
        keys, first = np.unique(block[order], return_index=True)
        groups = [order[at:to] for at, to in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([packed_ids(number[g], own.take(pa.array(g))) for g in groups], pa.binary())], names=["key", "data"])

    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(first, AT_ONCE)
            coded = part.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            table = bpe.learn(words[1:] if words[0] == last else words)
            if words[0] == last:
                table[last] = known
            last, known = words[-1], table[words[-1]]
            blocks_of.append(np.asarray(part.column(0)))
            numbers.append(np.asarray(part.column(1)))
            ids.append(pa.array([table[w] for w in words], pa.binary()).take(coded.indices))
            if sum(map(len, numbers)) >= PACKED:
                yield packed()
                blocks_of, numbers, ids = [], [], []
                pa.default_memory_pool().release_unused()
    if numbers:
        yield packed()


def encode_decode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row of docs: the id column, ids binary (little-endian unsigned 32-bit; left out unless keep_ids), n_tokens long,
    ids_sha256 string, decoded string (left out unless keep_ids), decoded_sha256 string.

    A null text counts as empty: no ids, and the digests are of no bytes. Repeated rows give repeated results; other columns are ignored.
    Numbers of words follow the order in which a task gets its rows, which two branches must agree on; so input from a shuffle is stored first.
    """
    docs = settled(docs.select(id_column, text_column))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if key < FIRST_BLOCK:
                    number, own = unpacked_words(data.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), block)), pa.array(number.astype(np.int32)), own], names=["block", "number", "word"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, coder(tokenizer))

    def joined(block: pa.Table, found: pa.Table) -> pa.Table:
        if block.num_rows != 1 or block.column("key")[0] != block.column("block")[0]:  # a part's words
            return empty
        pieces, piece_starts, piece_lengths = coder(tokenizer).piece_table
        told = [unpacked_ids(x) for x in found.column("data").to_pylist()]
        join = lambda i, kind: np.concatenate([x[i] for x in told]) if told else np.zeros(0, kind)
        order = np.argsort(join(0, np.int64), kind="stable")
        flat, lengths = join(2, np.uint32).astype(np.uint32), join(1, np.int64)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        numbers, counts = decoded_numbers(block.column("data")[0].as_py()), np.asarray(block.column("counts")[0].values)
        out: dict[str, list] = {name: [] for name in names}
        at = 0
        for n in counts.tolist():
            ids = _gathered(flat, starts, lengths, numbers[at : at + n])
            at += n
            decoded = _gathered(pieces, piece_starts, piece_lengths, ids).tobytes().decode("utf-8", "replace")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if keep_ids:
                out["ids"].append(ids.tobytes())
                out["decoded"].append(decoded)
        return pa.table([block.column("ids")[0].values, *(pa.array(out[n], t) for n, t in types)], names=[id_column, *names])

    types = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary()), ("decoded", pa.string())] * keep_ids
    names = [n for n, _ in types]
    id_type = docs.select(F.col(id_column)).schema[0].dataType
    empty = pa.schema([(id_column, to_arrow_type(id_type)), *types]).empty_table()
    whole = blocks(docs, tokenizer, FINER * partitions(docs.sparkSession), id_column, text_column).repartition("key")  # one exchange, which both uses below read
    # equal words are of one part, and so in one partition
    asked = whole.mapInArrow(words, "block long, number int, word string").sortWithinPartitions("word").select("block", "number", "word")
    found = asked.mapInArrow(encode, "key long, data binary")
    schema = f"`{id_column}` {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return whole.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(joined, schema)


def decode(tokens: DataFrame, tokenizer: str, keys: list[str]) -> DataFrame:
    """(keys, decoded string) for tokens (keys, position, id): the plain join of ids and pieces. Null or unknown ids stand for nothing; each key needs a row."""
    spark = tokens.sparkSession
    pieces = F.broadcast(spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(coder(tokenizer).pieces)], "id long, piece binary"))  # a row for each id of the vocabulary
    held = tokens.select(*keys, "position", F.col("id").cast("long").alias("id")).join(pieces, "id", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", F.hex("piece").alias("piece")))).alias("pieces"))
    return held.select(*keys, F.decode(F.unhex(F.array_join(F.transform("pieces", lambda p: p["piece"]), "")), "UTF-8").alias("decoded"))
