"""Adapter views: the operators' inputs, derived by fixed formulas from the tables at hand. SQL has the same formulas for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.functions.parse import first_number, time_spans
from scorelake.functions.temporal import segment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def qa(spark: SparkSession, d: str) -> DataFrame:
    """Two questions of each labelled document: task, source, reference and prediction arrays."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    says = lambda c: F.when(c == 1, "yes").otherwise("no")
    told = F.array(pick(F.col("n_chars") % 3, "Yes, it is", "No, not really", "Hard to say"), pick(F.floor(F.col("n_chars") / 3) % 3, "yes!", "NO", "nothing"))
    return rows.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("task"), "source", F.array(says(F.col("quality")), says(F.col("toxic"))).alias("reference"), told.alias("prediction"))


def mc_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 3).cast("string").alias("reference"), F.substring("o_orderpriority", 1, 1).alias("prediction"))


def mc_options(spark: SparkSession, d: str) -> DataFrame:
    options = F.array(*map(F.lit, ("ECONOMY", "LARGE", "MEDIUM", "PROMO")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("task"), options.alias("options"), (F.col("p_partkey") % 4).cast("int").alias("answer"), F.col("p_type").alias("prediction"))


def grounding(spark: SparkSession, d: str) -> DataFrame:
    """Answers in words with two gold intervals each: task, source, answer_text, pred (read from it), gold, number."""
    e = table(spark, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "shift": (F.col("event_id") % 11).cast("int"), "form": (F.col("event_id") % 4).cast("int")})
    a, b = F.col("k").cast("string"), (F.col("k") + 10).cast("string")
    told = pick(F.col("form"), "dash", "to", "words", "none")
    text = F.when(told == "dash", F.concat(F.lit("from "), a, F.lit(" - "), b, F.lit(" seconds, and "), (F.col("k") + 20).cast("string"), F.lit(" - "), (F.col("k") + 30).cast("string")))
    text = text.when(told == "to", F.concat(F.lit("from "), a, F.lit(" to  "), b)).when(told == "words", F.concat(F.lit("It starts at "), a, F.lit(" and ends at "), b)).otherwise("no idea")
    gold = F.array(segment(F.col("k") + F.col("shift"), F.col("k") + F.col("shift") + 12), segment(F.col("k") - 5, F.col("k") + 5))
    rows = e.select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("task"), (F.col("user_id") % 3).cast("string").alias("source"), text.alias("answer_text"), gold.alias("gold"), "k", "shift", "form")
    return rows.withColumns({"pred": time_spans(F.col("answer_text")), "number": first_number(F.col("answer_text"))})


def dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and gold intervals of conversations: (video, idx, span, sentence)."""
    c = table(spark, d, "conversations")
    s = F.col("conv_id") % 9
    gold = c.filter("role = 'user'").select(F.col("conv_id").alias("video"), F.col("turn").alias("idx"), segment(10 * F.col("turn"), 10 * F.col("turn") + 8).alias("span"), F.col("text").alias("sentence"))
    start = 10 * (F.col("turn") - 1) + s
    pred = c.filter("role = 'assistant'").select(F.col("conv_id").alias("video"), F.col("turn").alias("idx"), segment(start, start + 8).alias("span"), F.col("text").alias("sentence"))
    return pred, gold


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Judge replies as text (some fenced, some broken), with the category of each sample."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    winner = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("tie")
    body = F.concat(F.lit('{"winner": "'), winner, F.lit('", "confidence": '), F.substring("o_orderpriority", 1, 1), F.lit(', "reason": "order '), F.col("o_orderkey").cast("string"), F.lit('"}'))
    text = F.when(F.col("o_orderkey") % 17 == 0, F.lit("{broken")).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select(F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("category"), text.alias("verdict_json"))


def pairwise_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    winner = F.when(F.col("o_orderstatus") == "F", "Model A").when(F.col("o_orderstatus") == "O", "Model B").otherwise("Tie")
    body = F.concat(F.lit('{"winner": "'), winner, F.lit('", "confidence": 0.'), F.substring("o_orderpriority", 1, 1), F.lit("}"))
    return rows.select(F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("category"), F.when(F.col("o_orderkey") % 13 == 0, F.lit('{"winner": "Model A"}')).otherwise(body).alias("verdict_json"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a prediction, paired with one benchmark item as its reference."""
    items = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % items.select(F.count("*")).scalar())
    return docs.join(items.withColumnRenamed("text", "reference"), "item_id").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("source"), F.col("text").alias("prediction"), "reference")


def relations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    relation = F.when(F.col("l_returnflag") == "A", "entailment").when(F.col("l_returnflag") == "N", "neutral").otherwise("contradiction")
    return rows.select(F.col("l_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("source"), F.when(F.col("l_linestatus") == "O", "recall").otherwise("precision").alias("side"), relation.alias("relationship"))


def keyed(spark: SparkSession, d: str, side: int) -> DataFrame:
    """Records of one side by key, several for some keys."""
    rows = table(spark, d, "lineitem").filter(F.col("l_suppkey") % 2 == side)
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"))


KEYED_ORDER = ["line", "part", "supp", "price"]


def scene(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    said = pick((F.col("conv_id") + F.col("turn")) % 4, "That is correct", "incorrect", "yes and no", "unclear")
    return c.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("pos"), said.alias("raw_answer"), F.when(F.col("turn") % 7 == 6, "error").otherwise("success").alias("status"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    """Results of sources (as models) on languages (as datasets): mean quality and mean toxicity (as evaluators)."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    wide = rows.groupBy(F.col("source").alias("model"), F.col("lang").alias("dataset")).agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    each = F.explode(F.array(F.struct(F.lit("quality").alias("evaluator"), F.col("q").alias("value")), F.struct(F.lit("toxic").alias("evaluator"), F.col("t").alias("value")))).alias("x")
    return wide.select("model", "dataset", each).select("model", "dataset", "x.evaluator", F.lit("score").alias("metric"), "x.value")


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """(label, v): the mean vector of each label."""
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


# ---- the same formulas for the oracles ----

SQL = {
    "qa": """qa AS (
  SELECT d.doc_id AS sample_id, d.lang AS task, d.source, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS r0, CASE WHEN l.toxic = 1 THEN 'yes' ELSE 'no' END AS r1,
    CASE n_chars % 3 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN 'No, not really' ELSE 'Hard to say' END AS p0, CASE (n_chars // 3) % 3 WHEN 0 THEN 'yes!' WHEN 1 THEN 'NO' ELSE 'nothing' END AS p1
  FROM documents d JOIN labels l USING (doc_id))""",
    "grounding": """grounding AS (
  SELECT event_id AS sample_id, event_type AS task, CAST(user_id % 3 AS VARCHAR) AS source, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 11 AS shift, event_id % 4 AS form FROM events),
spans AS (
  SELECT sample_id, task, source, form, form = 3 AS failed, CAST(k AS DOUBLE) AS a, CAST(k + 10 AS DOUBLE) AS b, CAST(k + 20 AS DOUBLE) AS a2, CAST(k + 30 AS DOUBLE) AS b2,
    CAST(k + shift AS DOUBLE) AS g, CAST(k + shift + 12 AS DOUBLE) AS h, CAST(k - 5 AS DOUBLE) AS g2, CAST(k + 5 AS DOUBLE) AS h2 FROM grounding),
ious AS (
  SELECT *, greatest(0, least(b, h) - greatest(a, g)) / ((b - a) + (h - g) - greatest(0, least(b, h) - greatest(a, g))) AS i11,
    greatest(0, least(b, h2) - greatest(a, g2)) / ((b - a) + (h2 - g2) - greatest(0, least(b, h2) - greatest(a, g2))) AS i12,
    greatest(0, least(b2, h) - greatest(a2, g)) / ((b2 - a2) + (h - g) - greatest(0, least(b2, h) - greatest(a2, g))) AS i21,
    greatest(0, least(b2, h2) - greatest(a2, g2)) / ((b2 - a2) + (h2 - g2) - greatest(0, least(b2, h2) - greatest(a2, g2))) AS i22 FROM spans)""",
    "dense": """gold AS (SELECT conv_id AS video, turn AS idx, 10.0::DOUBLE * turn AS s, 10.0::DOUBLE * turn + 8 AS e, text AS sentence FROM conversations WHERE role = 'user'),
pred AS (SELECT conv_id AS video, turn AS idx, 10.0::DOUBLE * (turn - 1) + conv_id % 9 AS s, 10.0::DOUBLE * (turn - 1) + conv_id % 9 + 8 AS e, text AS sentence FROM conversations WHERE role = 'assistant'),
pairs AS (
  SELECT p.video, p.idx AS pred_i, g.idx AS ref_i, (least(p.e, g.e) - greatest(p.s, g.s)) / (least(greatest(p.e, g.e) - least(p.s, g.s), (p.e - p.s) + (g.e - g.s)) + 1e-8::DOUBLE) AS iou
  FROM pred p JOIN gold g ON p.video = g.video AND p.s < g.e AND g.s < p.e)""",
    "verdicts": """verdicts AS (
  SELECT o_orderkey AS sample_id, c_mktsegment AS category, o_orderkey % 17 <> 0 AS success, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'tie' END AS winner,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS confidence FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "captions": """captions AS (
  SELECT doc_id AS sample_id, lang AS source, d.text AS prediction, b.text AS reference FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)""",
    "relations": """relations AS (
  SELECT l_orderkey AS sample_id, o_orderpriority AS source, CASE WHEN l_linestatus = 'O' THEN 'recall' ELSE 'precision' END AS side,
    CASE l_returnflag WHEN 'A' THEN 'entailment' WHEN 'N' THEN 'neutral' ELSE 'contradiction' END AS relationship FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "keyed": """keyed AS (
  SELECT * FROM (SELECT l_suppkey % 2 AS side, l_orderkey AS id, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price,
    row_number() OVER (PARTITION BY l_suppkey % 2, l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1)""",
    "scene": """scene AS (
  SELECT conv_id AS sample_id, (conv_id + turn) % 4 AS said, turn % 7 <> 6 AS success FROM conversations)""",
    "cube": """cube AS (
  SELECT source AS model, lang AS dataset, 'quality' AS evaluator, avg(quality) AS value FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2
  UNION ALL SELECT source, lang, 'toxic', avg(toxic) FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)""",
    "words": """words AS (
  SELECT sample_id, source, CASE WHEN pn = '' THEN [] ELSE string_split(pn, ' ') END AS p, CASE WHEN rn = '' THEN [] ELSE string_split(rn, ' ') END AS r
  FROM (SELECT sample_id, source, lower(trim(regexp_replace(prediction, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS pn, lower(trim(regexp_replace(reference, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS rn FROM captions)),
told AS (
  SELECT sample_id, unnest(p) AS w, unnest(range(len(p))) AS i, 1 AS c, 0 AS f FROM words UNION ALL SELECT sample_id, unnest(r), unnest(range(len(r))), 0, 1 FROM words),
ahead AS (
  SELECT sample_id, c, f, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM told WINDOW o AS (PARTITION BY sample_id, c ORDER BY i)),
grams AS (
  SELECT sample_id, n, gram, sum(c)::BIGINT AS c, sum(f)::BIGINT AS f FROM (
    SELECT sample_id, 1 AS n, w AS gram, c, f FROM ahead UNION ALL SELECT sample_id, 2, w || ' ' || w2, c, f FROM ahead WHERE w2 IS NOT NULL
    UNION ALL SELECT sample_id, 3, w || ' ' || w2 || ' ' || w3, c, f FROM ahead WHERE w3 IS NOT NULL UNION ALL SELECT sample_id, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, c, f FROM ahead WHERE w4 IS NOT NULL)
  GROUP BY 1, 2, 3),
counts AS (SELECT sample_id, n, sum(least(c, f))::BIGINT AS matched, sum(c)::BIGINT AS nc, sum(f)::BIGINT AS nr FROM grams GROUP BY 1, 2)""",
}


def _treebank_sql(column: str) -> str:
    """The words of text.treebank."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    spaced = rf"' ' || lower(trim(regexp_replace(coalesce({column}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'))) || ' '"
    for pattern, to in text.TREEBANK_SPLITS:
        spaced = f"regexp_replace({spaced}, {quoted(pattern)}, {quoted(to)}, 'g')"
    ended = f"CASE WHEN regexp_matches(rtrim(t, ''''), {quoted(text.TREEBANK_ABBREVIATIONS)}) THEN rtrim(t, '''') ELSE regexp_replace(t, '[.'']+$', '') END"
    pairs = "CASE t " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in text.TREEBANK_PAIRS.items()) + f" ELSE CASE WHEN regexp_matches(t, {quoted(text.TREEBANK_ALONE)}) THEN t ELSE ltrim(t, '''') END END"
    parted = rf"regexp_replace({pairs}, {quoted(text.TREEBANK_ENDINGS)}, '\1 \2')"
    parts = f"list_transform(list_transform(regexp_split_to_array(trim({spaced}), ' +'), lambda t: {ended}), lambda t: {parted})"
    return f"list_filter(regexp_split_to_array(array_to_string({parts}, ' '), ' +'), lambda t: NOT regexp_matches(t, '^[-.'',:]*$'))"


# the n-grams and counts of SQL["words"], over Treebank tokens
SQL["treebank"] = f"words AS (SELECT sample_id, source, {_treebank_sql('prediction')} AS p, {_treebank_sql('reference')} AS r FROM captions),\n" + SQL["words"][SQL["words"].index("told AS") :]


def with_views(*names: str, then: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + then
