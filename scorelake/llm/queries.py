"""The queries opN_<name>: each operator on its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import alignment, byte_bpe, chat_format, cover_tree, fingerprints, language_id, line_dedup, near_dedup, packing, piece_counts, resampling, secret_scan, warc
from scorelake.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0).drop("payload")


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE, limit=4096)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end_id=0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_predict(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), least=10)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10_000, longest=1, least_words=20, percent=10, seed=2024)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :t), (-1L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", {"t": probe})
    return chat_format.digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_iblt_fingerprints": op1_iblt_fingerprints,
    "op2_secret_scan": op2_secret_scan,
    "op3_cover_tree": op3_cover_tree,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_bbit_minhash": op5_bbit_minhash,
    "op6_token_counts": op6_token_counts,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_alignment": op11_alignment,
    "op12_resampling": op12_resampling,
    "op13_chat_format": op13_chat_format,
}
TOP_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT page_id, h, s, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, 1 + 5 * (j // 4), 5) AS INTEGER) >> (15 - 5 * (j % 4))) & 31 AS INTEGER) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

SECRET_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, rank, pat, part, least) AS (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12), ('access', 1, '(AKIA[A-Z0-9]+)', 1, 18), ('hex', 2, '([0-9a-f]{16,})', 1, 16),
  ('key', 3, '([A-Za-z0-9+/]+=?)', 1, 40), ('endpoint', 4, '((?i:https?|s3|wss?|postgres|mysql|redis|mongodb)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+)', 1, 8)),
hits AS (SELECT doc_id, kind, rank, pat, part, least, regexp_extract_all(t, pat) AS w, string_split_regex(t, pat) AS gaps FROM t, kinds WHERE CASE WHEN rank < 3 THEN regexp_matches(t, pat) ELSE regexp_matches(t, 'AKIA[A-Z0-9]{14}') END),
placed AS (SELECT doc_id, kind, rank, pat, part, least, w[i] AS m, CAST(list_sum([length(x) FOR x IN gaps[1 : i]]) + coalesce(list_sum([length(x) FOR x IN w[1 : i - 1]]), 0) AS BIGINT) AS s FROM hits, unnest(range(1, len(w) + 1)) AS u(i)),
parts AS (SELECT doc_id, kind, rank, s, s + length(m) AS e FROM placed WHERE CASE WHEN rank = 3 THEN length(m) = 40 AND NOT contains(m, '=') WHEN part = 2 THEN length(regexp_extract(m, pat, 2)) >= least ELSE length(m) >= least END),
keys AS (SELECT * FROM parts k WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.doc_id = k.doc_id AND b.rank < 3 AND b.s < k.e AND k.s < b.e)
  AND EXISTS (SELECT 1 FROM parts a WHERE a.doc_id = k.doc_id AND a.rank = 1 AND a.s <= k.e + 200 AND k.s <= a.e + 200)),
secrets AS (SELECT * FROM keys UNION ALL SELECT * FROM parts WHERE rank = 0),
complete AS (SELECT * FROM parts a WHERE rank = 1 AND EXISTS (SELECT 1 FROM secrets x WHERE x.doc_id = a.doc_id AND x.s <= a.e + 200 AND a.s <= x.e + 200)),
ends AS (SELECT * FROM parts p WHERE rank = 4 AND EXISTS (SELECT 1 FROM complete a WHERE a.doc_id = p.doc_id AND a.s <= p.e + 200 AND p.s <= a.e + 200)),
found AS (SELECT * FROM parts WHERE rank < 3 UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM ends)
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank > 2) AS n_linked,
  sha256(coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank), '') AS spans
FROM t LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(2, len(w) - 1))) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- a pair at 85 % shares the rarest sixth of either set
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS r FROM s JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) USING (g)),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM (SELECT o.* FROM o JOIN n USING (doc_id) WHERE r <= n - ceil(0.85 * n) + 1) x JOIN (SELECT o.* FROM o JOIN n USING (doc_id) WHERE r <= n - ceil(0.85 * n) + 1) y ON x.g = y.g AND x.doc_id < y.doc_id),
i AS (SELECT a, b, count(*) AS n_both FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, translate(trim(l[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)
), seen AS (SELECT k, min(doc_id) AS first_id, count(DISTINCT doc_id) AS n FROM lines WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, i, line, coalesce(n >= 2 AND first_id < doc_id, false) AS lost FROM lines LEFT JOIN seen USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

RESAMPLING_SQL = r"""
WITH crc_table AS (SELECT [list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)] AS codes),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'raw' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'aim', item_id, text FROM benchmark)
), f AS (SELECT kind, id, unnest(w) AS f FROM w),
b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT) FOR i IN range(strlen(f))]), lambda c, x: xor(c >> 8, codes[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM f), crc_table
), n AS (SELECT bucket, count(*) FILTER (kind = 'raw') AS s, count(*) FILTER (kind = 'aim') AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS gain FROM n),
d AS (SELECT id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE kind = 'raw' GROUP BY id),
p AS (
  SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN d USING (id) WHERE kind = 'raw'
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM p WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM p LEFT JOIN r USING (doc_id)
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
), k AS (SELECT *, CASE WHEN conv_id IS NULL THEN concat_ws(chr(0), coalesce(CAST(turn AS VARCHAR), '-'), role, text) END AS lone,
  20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS chars FROM c),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS is_last FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id, lone
"""

ORACLES: dict[str, str] = {
    "op2_secret_scan": SECRET_SQL,
    "op3_cover_tree": TOP_SQL,
    "op4_warc_round_trip": WARC_SQL,
    "op5_bbit_minhash": NEAR_SQL,
    "op9_line_dedup": LINES_SQL,
    "op12_resampling": RESAMPLING_SQL,
    "op13_chat_format": CHAT_SQL,
}
