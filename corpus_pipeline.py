"""A training corpus from documents in five stages: language ID, line dedup, near-duplicate dedup, secret redaction, packing.

Each stage is a function (spark, docs, sf_dir) that works on all that its predecessor kept; all but the last return the columns of
documents. run writes each stage's rows to the shared folder and reads them again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import language_id, line_dedup, near_dedup, packing, secret_scan
from scorelake.llm.common import spare, table, written

#: Least share of a text's n-grams that its language must explain.
LEAST_SCORE = 0.3
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048

#: SQL has no form for these stages.
ORACLE_SQL = None


def _retold(frame: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents with another text; n_chars follows it."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return frame.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language: lang is the predicted one. Those without a letter, and those that no learnt language explains, go.
    Where no language was learnt, only those without a letter go, and lang is und. Null ids don't matter; repeated rows stay repeated."""
    lang, score = spare(docs.columns, "lang_pred", "score")
    columns = docs.columns
    filters = language_id.fit(docs)
    if not filters.learnt:
        kept = language_id.lettered(docs)
        return kept.select(*[F.lit(language_id.NONE).alias(c) if c == "lang" else F.col(f"`{c}`") for c in columns])
    found = language_id.predict(docs, filters, carry=tuple(columns), out=(lang, score))
    kept = found.filter((F.col(lang) != language_id.NONE) & (F.col(score) >= LEAST_SCORE))
    return kept.select(*[F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; a document that has lost its lines and has no other text goes. Rows of one id, and those with a null one, count as one document each; a null text is an empty one."""
    columns = docs.columns
    lines, dropped, kept = spare(columns, "n_lines", "n_dropped", "kept_text")
    found = line_dedup.dedup_lines(docs, least=10, carry=tuple(columns), out=(lines, dropped, kept))
    emptied = (F.col(dropped) > 0) & (F.length(F.btrim(kept, F.lit(" \t\n\x0b\x0c\r"))) == 0)
    return _retold(found.filter(~emptied), columns, kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that with the smallest id, a null id last. Rows are told apart by numbers of their own, so texts aren't linked by equal or null ids; of
    repeated rows one stays. Rows without words are no one's copies and stay."""
    columns = docs.columns
    row = spare(columns, "row")[0]
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_dedup.groups(numbered, words=5, percent=80, id_column=row)
    linked = written(found.filter("doc <> component").select("doc", "component"), "linked")
    members = linked.union(linked.select(F.col("component").alias("doc"), "component").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("doc"))
    first = members.join(numbered.select(F.col(row).alias("doc"), place.alias("place")), "doc").groupBy("component").agg(F.min("place").alias("first"))
    gone = members.select("doc").join(first.select("first.doc"), "doc", "left_anti")
    return numbered.join(gone.select(F.col("doc").alias(row)), row, "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; every row stays, with null and empty texts as they are."""
    clean = secret_scan.redact(docs)
    return _retold(clean, docs.columns, "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is an empty one; repeated rows are packed as often, and a null id stays null."""
    return packing.best_fit(docs, TOKENIZER, CAPACITY, end_id=0)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("secret_scan", redact_secrets), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
