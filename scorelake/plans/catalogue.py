"""Queries by operator id, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import adapters, judged
from scorelake.functions import jsons, parse, temporal, text
from scorelake.operators import answers, captions, dense, events, grounding, judging, options, report
from scorelake.plans import views
from scorelake.plans.views import table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- scans, projections, filters ----


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, source, lang AS task, n_chars,
  CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words
  FROM (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents)""")
def s2_prediction_scan(spark, d):
    rows = table(spark, d, "documents")
    return rows.select(F.col("doc_id").cast("string").alias("id"), "source", F.col("lang").alias("task"), "n_chars", F.size(captions.tokens("text")).cast("long").alias("n_words"))


@query(with_views("keyed", then="SELECT side || '/' || id AS id, part, supp, price FROM keyed WHERE id <> 0"))
def s16_last_wins_index(spark, d):
    """Both sides' records, each side's by keys of its own."""
    sided = lambda side: views.keyed(spark, d, side).filter("id <> 0").withColumn("id", F.concat(F.lit(f"{side}/"), F.col("id").cast("string")))
    return judging.latest(sided(0).union(sided(1)), "id", views.KEYED_ORDER).select("id", "part", "supp", "price")


@query(with_views("qa", then="SELECT sample_id, 0 AS pos, r0 AS reference, p0 AS prediction FROM qa UNION ALL SELECT sample_id, 1, r1, p1 FROM qa"))
def p2_pack_qa_arrays(spark, d):
    return answers.zipped(views.qa(spark, d), "reference", "prediction", keep=("sample_id",))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN c_mktsegment ELSE c_name END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey""")
def p4_first_truthy(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.col("o_orderkey") % 3
    label = text.first_truthy(F.when(n == 0, F.col("o_orderpriority")).when(n == 1, " "), F.when(n == 1, F.col("c_mktsegment")).when(n == 2, ""), F.col("c_name"))
    return rows.select(F.col("o_orderkey").alias("id"), label.alias("label"))


@query(with_views("keyed", then="SELECT id, price FROM keyed WHERE side = 0 AND id <> 0 AND id IN (SELECT id FROM keyed WHERE side = 1)"))
def f1_exists_semi(spark, d):
    return judging.latest(views.keyed(spark, d, 0), "id", views.KEYED_ORDER).join(views.keyed(spark, d, 1), "id", "left_semi").select("id", "price")


@query(with_views("keyed", then="SELECT id, price FROM keyed WHERE side = 0 AND id <> 0 AND id NOT IN (SELECT id FROM keyed WHERE side = 1)"))
def f1_missing_anti(spark, d):
    return judging.latest(views.keyed(spark, d, 0), "id", views.KEYED_ORDER).join(views.keyed(spark, d, 1), "id", "left_anti").select("id", "price")


@query("""SELECT source, count(*) AS failed FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR trim(text) = '' GROUP BY source""")
def f2_missing_required(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("quality", F.col("quality").cast("string"))
    return events.missing_required(rows, "text", "quality")


@query("""SELECT count(*) FILTER (o_orderpriority = '1-URGENT' OR o_orderstatus = 'P') AS filtered, count(*) FILTER (NOT (o_orderpriority = '1-URGENT' OR o_orderstatus = 'P')) AS successful,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS skipped FROM orders""")
def f6_content_filtered(spark, d):
    a = F.when(F.col("o_orderpriority") == "1-URGENT", "[Content filtered by policy]").when(F.col("o_orderstatus") == "P", "error: Content_Filter").otherwise("a fine answer")
    rows = judging.screened(table(spark, d, "orders").select(a.alias("response_a"), F.lit("other").alias("response_b")))
    audit = text.audit_filtered(F.col("response_a"))
    return rows.agg(F.count_if(audit).alias("filtered"), F.count_if(~audit).alias("successful"), F.count_if("skipped").alias("skipped"))


# ---- joins and sets ----


@query(with_views("keyed", then="SELECT a.id, a.price AS a_price, b.price AS b_price FROM keyed a JOIN keyed b ON a.side = 0 AND b.side = 1 AND a.id = b.id AND a.id <> 0"))
def j1_common_ids(spark, d):
    a, b = (judging.latest(views.keyed(spark, d, side), "id", views.KEYED_ORDER) for side in (0, 1))
    return judging.common(a, b).select("id", F.col("a.price").alias("a_price"), F.col("b.price").alias("b_price"))


@query("""SELECT coalesce(c_mktsegment, 'unknown') AS category, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1""")
def j2_lookup_default(spark, d):
    lookup = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category"))
    return judging.with_default(table(spark, d, "orders"), lookup, "o_custkey", "category").groupBy("category").agg(F.count("*").alias("n"))


@query(with_views("captions", "words", then="SELECT sample_id, n, matched AS overlap, nc AS n_candidate, nr AS n_reference FROM counts"))
def j4_ngram_full_outer(spark, d):
    met = captions.matches(views.captions(spark, d), "sample_id", "prediction", "reference")
    return met.select("sample_id", "n", F.col("matched").alias("overlap"), "n_candidate", "n_reference")


@query(with_views("dense", then="SELECT video, pred_i, ref_i, round(iou, 6) AS iou FROM pairs"))
def j5_interval_pairs(spark, d):
    return dense.overlaps(*views.dense(spark, d)).select("video", "pred_i", "ref_i", F.round("iou", 6).alias("iou"))


@query(with_views("dense", then="SELECT video, idx AS pred_i FROM pred p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.video = p.video AND q.pred_i = p.idx AND q.iou >= 0.5::DOUBLE)"))
def j11_unmatched_preds(spark, d):
    return dense.unmatched(*views.dense(spark, d), 0.5)


@query(with_views("cube", then="SELECT model AS name FROM cube UNION SELECT dataset FROM cube UNION SELECT evaluator FROM cube"))
def e2_union_names(spark, d):
    cube = views.cube(spark, d)
    return cube.select(F.col("model").alias("name")).union(cube.select("dataset")).union(cube.select("evaluator")).distinct()


@query("""SELECT DISTINCT doc_id AS sample_id, trim(line) AS question FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, '|') AND NOT contains(lower(line), 'no mention')""")
def e4_distinct_questions(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.explode(answers.scene_questions(F.col("text"))).alias("question")).distinct()


@query("""SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0""")
def e1_intersect_ids(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey"))


# ---- readings of text ----


@query("""SELECT doc_id AS sample_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))) AS digest FROM documents""")
def t1_preprocess(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.md5(text.normalise(F.col("text"))).alias("digest"))


@query(with_views("qa", then="""SELECT sample_id, CASE WHEN lower(p0) LIKE 'yes%' THEN 'Yes.' WHEN lower(p0) LIKE 'no%' THEN 'No.' END AS first_prefix, CASE WHEN lower(p1) LIKE 'yes%' THEN 'Yes.' WHEN lower(p1) LIKE 'no%' THEN 'No.' END AS second_prefix,
  CASE WHEN regexp_matches(lower(p1), '(^|[^a-z])yes($|[^a-z])') THEN true WHEN regexp_matches(lower(p1), '(^|[^a-z])no($|[^a-z])') THEN false END AS second_said FROM qa"""))
def t12_yes_no(spark, d):
    p = F.col("prediction")
    return views.qa(spark, d).select("sample_id", text.answer_prefix(p[0]).alias("first_prefix"), text.answer_prefix(p[1]).alias("second_prefix"), text.yes_no(p[1]).alias("second_said"))


@query(with_views("qa", then="SELECT sample_id, regexp_matches(lower(p0), '(^|[^a-z])' || r0 || '($|[^a-z])') AS first_hit, regexp_matches(lower(p1), '(^|[^a-z])' || r1 || '($|[^a-z])') AS second_hit FROM qa"))
def t13_word_contains(spark, d):
    hit = lambda i: text.has_word(F.col("prediction")[i], F.col("reference")[i])
    return views.qa(spark, d).select("sample_id", hit(0).alias("first_hit"), hit(1).alias("second_hit"))


@query(with_views("grounding", then="SELECT sample_id, CASE WHEN form < 3 THEN CAST(k AS DOUBLE) END AS number FROM grounding"))
def t5_first_number(spark, d):
    return views.grounding(spark, d).select("sample_id", "number")


@query(with_views("grounding", then='SELECT sample_id, 0 AS seg_i, a AS "start", b AS "end" FROM spans WHERE form < 3 UNION ALL SELECT sample_id, 1, a2, b2 FROM spans WHERE form = 0'))
def t6_segments(spark, d):
    rows = views.grounding(spark, d).select("sample_id", F.posexplode("pred").alias("seg_i", "s"))
    return rows.select("sample_id", "seg_i", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, 'part_' || l_partkey AS head, l_returnflag AS tail, printf('%.1f%%', l_discount * 100) AS discount, printf('%.3f', l_extendedprice) AS price FROM lineitem""")
def t22_split_and_format(spark, d):
    rows = table(spark, d, "lineitem")
    parts = text.split_last(F.concat(F.lit("part_"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_returnflag")))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), parts["head"].alias("head"), parts["tail"].alias("tail"), text.percent(F.col("l_discount")).alias("discount"), text.fixed(F.col("l_extendedprice"), 3).alias("price"))


@query(with_views("verdicts", then="SELECT sample_id, CASE WHEN success THEN winner ELSE 'error' END AS winner, CASE WHEN success THEN confidence END AS confidence, CASE WHEN success THEN 'ok' ELSE 'error' END AS status FROM verdicts"))
def n3_verdict_json(spark, d):
    v = jsons.verdict(F.col("verdict_json"))
    return views.verdicts(spark, d).select("sample_id", v.alias("v")).select("sample_id", "v.winner", "v.confidence", "v.status")


PAIRWISE_SQL = """replies AS (
  SELECT o_orderkey AS sample_id, c_mktsegment AS category, CASE WHEN o_orderkey % 13 = 0 THEN 'Tie' WHEN o_orderstatus = 'F' THEN 'Model A' WHEN o_orderstatus = 'O' THEN 'Model B' ELSE 'Tie' END AS winner,
    CASE WHEN o_orderkey % 13 = 0 THEN 0.0::DOUBLE ELSE CAST('0.' || substr(o_orderpriority, 1, 1) AS DOUBLE) END AS confidence, CASE WHEN o_orderkey % 13 = 0 THEN 'parse_error' ELSE 'ok' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _replies(spark, d):
    rows = views.pairwise_replies(spark, d).select("sample_id", "category", jsons.pairwise(F.col("verdict_json")).alias("v"))
    return rows.select("sample_id", "category", "v.winner", "v.confidence", "v.status")


@query(f"WITH {PAIRWISE_SQL} SELECT * EXCLUDE (category) FROM replies")
def n4_pairwise_json(spark, d):
    return _replies(spark, d).drop("category")


@query("""SELECT conv_id AS sample_id, CAST(unnest([0, 1]) AS INTEGER) AS i, unnest([10.0::DOUBLE * turn, 10.0::DOUBLE * turn + 10]) AS "start", unnest([10.0::DOUBLE * turn + 4.5, 10.0::DOUBLE * turn + 12]) AS "end",
  unnest(['someone says line ' || turn, 'then it is over']) AS sentence, turn FROM conversations""")
def t7_timed_captions(spark, d):
    t = F.col("turn") * 10
    at = lambda x: x.cast("string")
    told = F.concat(at(t), F.lit(" - "), at(t + 4), F.lit(".5 seconds, Someone says line "), at(F.col("turn")), F.lit(" "), at(t + 10), F.lit("-"), at(t + 12), F.lit(" seconds, then it is over"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", F.posexplode(parse.timed_captions(told)).alias("i", "c"))
    return rows.select("sample_id", "turn", "i", F.col("c.span.start").alias("start"), F.col("c.span.end").alias("end"), F.col("c.sentence").alias("sentence"))


@query("""SELECT p_partkey AS part, CAST(floor(w * least(1.0::DOUBLE, 512.0::DOUBLE / greatest(w, h))) AS INTEGER) AS width, CAST(floor(h * least(1.0::DOUBLE, 512.0::DOUBLE / greatest(w, h))) AS INTEGER) AS height FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 30 AS h FROM part)""")
def m7_fitted_size(spark, d):
    size = temporal.fitted(F.col("p_size") * 40, F.col("p_size") * 30)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), size.alias("s")).select("part", "s.width", "s.height")


@query("""SELECT conv_id AS sample_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def n2_event_lists(spark, d):
    rows = table(spark, d, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.concat(F.lit('```json\n{"events": ['), F.array_join(F.transform(F.collect_list("turn"), lambda t: F.concat(F.lit('"turn '), t.cast("string"), F.lit('", " "'))), ", "), F.lit("]}\n```")).alias("reply"))
    return rows.select(F.col("conv_id").alias("sample_id"), F.size(jsons.events(F.col("reply"), 10_000)).cast("long").alias("n"))


# ---- answers ----


@query(with_views("scene", then="SELECT round(avg(CASE WHEN success THEN 1.0 ELSE 0.5 END), 5) AS mean, round(stddev_samp(CASE WHEN success THEN 1.0 ELSE 0.5 END), 5) AS std, count(*) AS num_evaluated FROM scene"))
def a1_score_summary(spark, d):
    rows = views.scene(spark, d).withColumn("score", F.when(F.col("status") == "success", 1.0).otherwise(0.5))
    return answers_summary(rows)


def answers_summary(rows: DataFrame) -> DataFrame:
    return captions.score_summary(rows, "score")


SAMPLES_SQL = """counted AS (
  SELECT sample_id, source, count(*) FILTER (side = 'recall') AS ng, count(*) FILTER (side = 'recall' AND relationship = 'entailment') AS hg, count(*) FILTER (side = 'precision') AS np,
    count(*) FILTER (side = 'precision' AND relationship IN ('entailment', 'neutral')) AS hp FROM relations GROUP BY 1, 2),
rated AS (SELECT sample_id, source, CASE WHEN ng = 0 THEN 1.0 ELSE hg / ng END AS recall, CASE WHEN np = 0 THEN 1.0 ELSE hp / np END AS precision FROM counted),
scores AS (SELECT *, CASE WHEN recall <= 0 OR precision <= 0 THEN 0.0 ELSE 2 * recall * precision / (recall + precision) END AS f1 FROM rated)"""


def _relations(then: str) -> str:
    return f"WITH {views.SQL['relations']},\n{SAMPLES_SQL}\n{then}"


@query(_relations("SELECT sample_id, source, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM scores"))
def a2_autodq_sample(spark, d):
    own = events.sample_scores(views.relations(spark, d))
    return own.select("sample_id", "source", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(_relations("SELECT count(*) AS n, round(avg(f1), 5) AS f1, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(stddev_samp(f1), 5) AS std FROM scores"))
def a3_autodq_overall(spark, d):
    return events.overall(events.sample_scores(views.relations(spark, d)))


@query(_relations("""SELECT coalesce(s.source, 'OVERALL') AS source, success, round(r, 5) AS recall, round(p, 5) AS precision, round(CASE WHEN r <= 0 OR p <= 0 THEN 0 ELSE 2 * r * p / (r + p) END, 5) AS f1, coalesce(failed, 0) AS failed
  FROM (SELECT source, count(*) AS success, avg(recall) AS r, avg(precision) AS p FROM scores GROUP BY ROLLUP (source)) s
  LEFT JOIN (SELECT o_orderpriority AS source, count(*) AS failed FROM orders WHERE o_orderstatus = 'P' GROUP BY ROLLUP (o_orderpriority)) f ON f.source IS NOT DISTINCT FROM s.source"""))
def a4_autodq_category(spark, d):
    failures = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("source"))
    return events.by_source(events.sample_scores(views.relations(spark, d)), failures)


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings), c AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2),
s AS (SELECT vec_id, x.label, c.label AS choice, round(sum(x.x * c.x), 9) AS sim FROM x JOIN c USING (pos) GROUP BY 1, 2, 3),
b AS (SELECT vec_id, label, choice FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, choice) AS n FROM s) WHERE n = 1)
SELECT label, count(*) AS total, round(avg(CASE WHEN choice = label THEN 1 ELSE 0 END), 5) AS acc FROM b GROUP BY label""")
def a6_referring_acc(spark, d):
    rows = options.nearest_option(table(spark, d, "embeddings"), "embedding", views.centroids(spark, d), "label", "v")
    return rows.groupBy("label").agg(F.count("*").alias("total"), F.round(F.avg((F.col("choice") == F.col("label")).cast("int")), 5).alias("acc"))


@query("""SELECT p_brand AS task, count(*) AS total, count(*) FILTER (p_partkey % 6 >= 4) AS failed, round(avg(CASE WHEN p_partkey % 6 < 4 AND p_partkey % 6 = p_size % 4 THEN 1 ELSE 0 END), 5) AS acc FROM part GROUP BY p_brand""")
def a6_choice_letters(spark, d):
    n = F.col("p_partkey") % 6
    said = F.when(n == 0, "(A) first").when(n == 1, "Best option: (B").when(n == 2, "C. third").when(n == 3, "d").when(n == 4, " ").otherwise("none of these")
    gold = F.get(F.array(*map(F.lit, "abcd")), F.col("p_size") % 4)
    rows = table(spark, d, "part").select(F.col("p_brand").alias("task"), parse.choice(said, gold).alias("outcome"))
    return answers.choice_accuracy(rows, "task")


OPTIONS = ["red", "green", "blue", "[1.5, 20]"]


def _chosen(spark, d, *texts):
    """Answers of six forms, with the gold letter and the options."""
    n = F.col("p_partkey") % 6
    said = F.lit(texts[-1])
    for i, told in reversed(list(enumerate(texts[:-1]))):
        said = F.when(n == i, told).otherwise(said)
    return table(spark, d, "part").select(F.col("p_brand").alias("task"), said.alias("said"), F.get(F.array(*map(F.lit, "abcd")), F.col("p_size") % 4).alias("gold"), F.array(*map(F.lit, OPTIONS)).alias("options"))


@query("""SELECT p_brand AS task, count(*) AS total, count(*) FILTER (n IN (1, 2, 3, 5)) AS failed, round(avg(CAST(CASE n WHEN 0 THEN g = 0 WHEN 1 THEN g = 2 WHEN 2 THEN g = 0 WHEN 3 THEN false WHEN 4 THEN g = 3 OR g = 2 ELSE g = 1 END AS INTEGER)), 5) AS acc
  FROM (SELECT p_brand, p_partkey % 6 AS n, p_size % 4 AS g FROM part) GROUP BY p_brand""")
def t3_choice_similarity(spark, d):
    """Letters that aren't there, or are wrong, fall through to the option most similar to the answer."""
    rows = _chosen(spark, d, "(A) first", "it is blue", "none of them fits", "", "(D) but blue", "green one")
    return answers.choice_accuracy(rows.select("task", parse.choice(F.col("said"), F.col("gold"), F.col("options"), captions.hashed_similarity).alias("outcome")), "task")


@query("""SELECT p_brand AS task, count(*) AS total, count(*) FILTER (n = 3) AS failed, round(avg(CAST(CASE n WHEN 0 THEN g = 0 WHEN 1 THEN g = 2 WHEN 2 THEN g = 1 WHEN 3 THEN false WHEN 4 THEN g = 3 ELSE g = 3 END AS INTEGER)), 5) AS acc
  FROM (SELECT p_brand, p_partkey % 6 AS n, p_size % 4 AS g FROM part) GROUP BY p_brand""")
def t4_gvq_choice(spark, d):
    """Letters at the start alone count, and decide; brackets within a sentence don't."""
    rows = _chosen(spark, d, "(A) first", "it is blue", "I think it is (A), no, green", " ", "Best option: d, or blue", "from 1.5 - 20 s")
    return answers.choice_accuracy(rows.select("task", parse.leading_choice(F.col("said"), F.col("gold"), F.col("options"), captions.hashed_similarity).alias("outcome")), "task")


@query("""SELECT p_partkey, ['(A) ' || p_brand, '(B) ' || p_size || ' - ' || (p_size + 1), '(C) ' || p_type] AS lines FROM part""")
def p15_option_lines(spark, d):
    pair = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") + 1).cast("string"), F.lit("]"))
    return table(spark, d, "part").select("p_partkey", parse.option_lines(F.array("p_brand", pair, "p_type")).alias("lines"))


@query("""SELECT lang AS task, count(*) AS total, count(*) FILTER (doc_id % 5 <> 0 AND contains(source, '1')) AS correct, round(count(*) FILTER (doc_id % 5 <> 0 AND contains(source, '1')) / count(*), 5) AS acc FROM documents GROUP BY lang""")
def a20_description(spark, d):
    """Descriptions by a judge's yes or no; a blank one isn't asked about and is wrong."""
    text = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("it shows "), "source"))
    samples = table(spark, d, "documents").select(F.col("lang").alias("task"), F.array(F.lit("yes"), text).alias("prediction"), F.array(F.lit("Yes."), F.lit("a place")).alias("reference_text"))
    judge = adapters.Rule(lambda rows: F.when(F.contains("prompt", F.lit("1")), "**Yes**, it does").otherwise("No."))
    told = judged.described(samples, judge).groupBy("task").agg(F.count("*").alias("total"), F.count_if("matched").alias("correct"))
    return told.withColumn("acc", F.round(F.col("correct") / F.col("total"), 5))


@query("""SELECT doc_id, 'e' || (doc_id % 3) || ', last' AS entities FROM documents""")
def l5_entities(spark, d):
    lines = F.concat(F.lit("Background | field\nCamera | still\nno line\n1 | e"), (F.col("doc_id") % 3).cast("string"), F.lit("\n2 |  last "))
    return table(spark, d, "documents").select("doc_id", answers.entity_names(lines).alias("entities"))


@query("""SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":[1,2]}' AS canonical, 'm_d_' || substr(md5('{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":[1,2]}'), 1, 8) AS key FROM events""")
def n6_canonical_json(spark, d):
    odd = jsons.canonical_json(F.concat(F.lit('{ "b": [1, 2], "a": '), "props", F.lit("}")))
    return table(spark, d, "events").select("event_id", odd.alias("canonical"), temporal.cache_key(F.lit("m"), F.lit("d"), odd).alias("key"))


@query("""SELECT page_id, to_base64(encode(html)) AS encoded, substr(html, 1, 100) AS shown FROM pages""")
def m9_base64(spark, d):
    return table(spark, d, "pages").select("page_id", text.encoded(F.col("html").cast("binary")).alias("encoded"), text.shortened(F.col("html"), 100).alias("shown"))


@query(with_views("qa", then="""SELECT task, count(*) AS n, round(avg(CAST(h0 AS INTEGER)), 5) AS basic, round(avg(CAST(h1 AS INTEGER)), 5) AS halluc, round(avg(CAST(h0 AND h1 AS INTEGER)), 5) AS both FROM (
  SELECT task, regexp_matches(lower(p0), '(^|[^a-z])' || r0 || '($|[^a-z])') AS h0, regexp_matches(lower(p1), '(^|[^a-z])' || r1 || '($|[^a-z])') AS h1 FROM qa) GROUP BY task""".replace(" AS both", ' AS "both"')))
def a17_hallucination_task(spark, d):
    return answers.pair_accuracy(views.qa(spark, d))


@query(with_views("qa", then="""SELECT count(*) AS tasks, round(avg(basic), 5) AS basic, round(avg(halluc), 5) AS halluc, round(avg("both"), 5) AS "both", round((round(avg(basic), 5) + round(avg(halluc), 5)) / 2, 5) AS fact_score FROM (
  SELECT task, round(avg(CAST(h0 AS INTEGER)), 5) AS basic, round(avg(CAST(h1 AS INTEGER)), 5) AS halluc, round(avg(CAST(h0 AND h1 AS INTEGER)), 5) AS "both" FROM (
    SELECT task, regexp_matches(lower(p0), '(^|[^a-z])' || r0 || '($|[^a-z])') AS h0, regexp_matches(lower(p1), '(^|[^a-z])' || r1 || '($|[^a-z])') AS h1 FROM qa) GROUP BY task)"""))
def a18_hallucination_overall(spark, d):
    means = answers.macro(answers.pair_accuracy(views.qa(spark, d)), "basic", "halluc", "both")
    return means.withColumn("fact_score", F.round((F.col("basic") + F.col("halluc")) / 2, 5))


PREFIX_SQL = """marked AS (SELECT task, CASE WHEN lower(p0) LIKE 'yes%' THEN 'yes' WHEN lower(p0) LIKE 'no%' THEN 'no' END AS s, r0 AS r FROM qa UNION ALL
  SELECT task, CASE WHEN lower(p1) LIKE 'yes%' THEN 'yes' WHEN lower(p1) LIKE 'no%' THEN 'no' END, r1 FROM qa),
tasks AS (SELECT task, count(*) AS total, count(*) FILTER (s = r) AS correct, count(*) FILTER (s IS NULL) AS unread FROM marked GROUP BY task)"""


def _prefixed(spark, d):
    return views.qa(spark, d).withColumn("reference", F.transform("reference", lambda r: F.when(r == "yes", "Yes.").otherwise("No.")))


@query(f"WITH {views.SQL['qa']},\n{PREFIX_SQL} SELECT *, round(correct / total, 5) AS acc, round(unread / total, 5) AS not_match FROM tasks")
def a19_yes_no(spark, d):
    return answers.prefix_accuracy(_prefixed(spark, d))


@query(f"WITH {views.SQL['qa']},\n{PREFIX_SQL} SELECT sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, round(sum(correct) / sum(total), 5) AS acc FROM tasks")
def a21_micro_overall(spark, d):
    return answers.micro(answers.prefix_accuracy(_prefixed(spark, d)))


@query("""WITH q AS (SELECT CAST(o_orderkey % 3 AS VARCHAR) AS r, substr(o_orderpriority, 1, 1) AS p FROM orders)
SELECT count(*) AS total, count(*) FILTER (p IN ('0', '1', '2')) AS answered, count(*) FILTER (p = r) AS correct, round(count(*) FILTER (p = r) / count(*), 5) AS acc FROM q""")
def a22_mc_digits(spark, d):
    return answers.digit_accuracy(views.mc_digits(spark, d), ["0", "1", "2"])


@query("""WITH q AS (SELECT p_brand AS task, p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO') AS answered, p_type = (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO'])[p_partkey % 4 + 1] AS correct FROM part)
SELECT coalesce(task, 'OVERALL') AS task, count(*) AS total, count(*) FILTER (answered) AS answered, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 5) AS acc, round(count(*) FILTER (answered) / count(*), 5) AS answered_rate FROM q GROUP BY ROLLUP (task)""")
def a23_mc_options(spark, d):
    return answers.option_accuracy(views.mc_options(spark, d))


SCENE_SQL = """told AS (SELECT sample_id, count(*) AS total, count(*) FILTER (success) AS answered, count(*) FILTER (success AND said IN (0, 2)) AS n_yes, count(*) FILTER (success AND said = 1) AS n_no, count(*) FILTER (success AND said = 3) AS n_unclear FROM scene GROUP BY 1)"""


@query(f"WITH {views.SQL['scene']},\n{SCENE_SQL} SELECT *, round(n_yes / total, 4) AS yes_rate, round(n_no / total, 4) AS no_rate, round((n_yes + n_no) / total, 4) AS clarity FROM told")
def a24_scene_qa(spark, d):
    return answers.scene_answers(views.scene(spark, d), "sample_id")


@query(f"""WITH {views.SQL['scene']},\n{SCENE_SQL}, s AS (SELECT count(*) AS samples, sum(total)::BIGINT AS total, sum(answered)::BIGINT AS answered, sum(n_yes)::BIGINT AS n_yes, sum(n_no)::BIGINT AS n_no, sum(n_unclear)::BIGINT AS n_unclear FROM told)
SELECT *, round(n_yes / total, 4) AS yes_rate, round(n_no / total, 4) AS no_rate, round((n_yes + n_no) / total, 4) AS clarity FROM s""")
def a24_scene_overall(spark, d):
    return answers.scene_overall(views.scene(spark, d), "sample_id")


# ---- grounding ----

_SHARES = {t: str(int(round(t * 100))) for t in grounding.THRESHOLDS}


def _over(value: str, prefix: str) -> str:
    return ", ".join(f"round(avg(CASE WHEN {value} >= {t}::DOUBLE THEN 1 ELSE 0 END), 5) AS {prefix}_{n}" for t, n in _SHARES.items())


def _mean(prefix: str) -> str:
    return "round((" + " + ".join(f"{prefix}_{n}" for n in _SHARES.values()) + ") / 4, 5)"


def _grounded(select: str, rest: str = "") -> str:
    return with_views("grounding", then=f"SELECT *{rest} FROM (SELECT task, source, count(*) AS total, count(*) FILTER (failed) AS failed, {select} FROM ious GROUP BY task, source)")


_FIRST = "CASE WHEN failed THEN 0 ELSE i11 END"
_BEST = "CASE WHEN failed THEN 0 ELSE greatest(i11, i12) END"
# shares of gold and predicted intervals that the other side meets; two predicted ones where form is 0
_LOCAL = {
    t: f"""CASE WHEN failed THEN 0 WHEN gs = 0 OR ps = 0 THEN 0 ELSE 2 * gs * ps / (gs + ps) END""".replace("gs", f"g{n}").replace("ps", f"p{n}") for t, n in _SHARES.items()
}
_LOCAL_COLUMNS = ", ".join(
    f"""((CASE WHEN greatest(i11, CASE WHEN form = 0 THEN i21 ELSE 0 END) >= {t}::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN greatest(i12, CASE WHEN form = 0 THEN i22 ELSE 0 END) >= {t}::DOUBLE THEN 1 ELSE 0 END)) / 2 AS g{n},
    ((CASE WHEN greatest(i11, i12) >= {t}::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN form = 0 AND greatest(i21, i22) >= {t}::DOUBLE THEN 1 ELSE 0 END)) / (CASE WHEN form = 0 THEN 2 ELSE 1 END) AS p{n}""" for t, n in _SHARES.items()
)


@query(_grounded(f"round(avg({_FIRST}), 5) AS miou, {_over(_FIRST, 'f1')}", f", {_mean('f1')} AS f1"))
def a7_tvg(spark, d):
    return grounding.first_span(views.grounding(spark, d))


@query(with_views("grounding", then="SELECT task, source, count(*) AS total, count(*) FILTER (failed) AS failed, round(avg(CASE WHEN NOT failed AND ((a >= g AND a <= h) OR (a >= g2 AND a <= h2)) THEN 1 ELSE 0 END), 5) AS f1 FROM spans GROUP BY task, source"))
def a8_vhd(spark, d):
    return grounding.moment(views.grounding(spark, d))


@query(_grounded(f"round(avg({_BEST}), 5) AS miou, {_over(_BEST, 'r')}", f", {_mean('r')} AS mrec"))
def a9_tem(spark, d):
    return grounding.event_match(views.grounding(spark, d))


@query(with_views("grounding", then=f"""SELECT *, {_mean('f1')} AS f1 FROM (SELECT task, source, count(*) AS total, count(*) FILTER (failed) AS failed, {", ".join(f"round(avg({c}), 5) AS f1_{_SHARES[t]}" for t, c in _LOCAL.items())}
  FROM (SELECT task, source, failed, {_LOCAL_COLUMNS} FROM ious) GROUP BY task, source)"""))
def a10_tal(spark, d):
    return grounding.localisation(views.grounding(spark, d))


SLOTS_SQL = """, sets AS (SELECT task, source, failed, list_distinct(range(greatest(0, a)::INTEGER, b::INTEGER) || CASE WHEN form = 0 THEN range(a2::INTEGER, b2::INTEGER) ELSE [] END) AS p,
  list_distinct(range(greatest(0, g)::INTEGER, h::INTEGER) || range(greatest(0, g2)::INTEGER, greatest(0, h2)::INTEGER)) AS q FROM spans),
rated AS (SELECT task, source, failed, CASE WHEN failed THEN NULL WHEN len(list_intersect(p, q)) = 0 THEN 0 ELSE 2 * len(list_intersect(p, q)) / (len(p) + len(q)) END AS f FROM sets)
SELECT task, source, count(*) AS total, count(*) FILTER (failed) AS failed, coalesce(round(avg(f), 5), 0.0) AS f1 FROM rated GROUP BY task, source"""


@query("WITH " + views.SQL["grounding"] + SLOTS_SQL)
def a11_evs(spark, d):
    return grounding.summary(views.grounding(spark, d))


_RIGHT = "CASE WHEN sample_id % 3 = 0 AND NOT failed THEN i11 ELSE 0 END"


@query(with_views("grounding", then=f"""SELECT *, {_mean('r')} AS mrec FROM (SELECT task, source, count(*) AS total, count(*) FILTER (sample_id % 5 = 4 AND sample_id % 3 <> 0 OR (sample_id % 3 = 0 AND failed)) AS failed,
  round(avg(CASE WHEN sample_id % 3 = 0 THEN 1 ELSE 0 END), 5) AS acc, round(avg({_RIGHT}), 5) AS miou, {_over(_RIGHT, 'r')} FROM ious GROUP BY task, source)"""))
def a13_gvq(spark, d):
    n = F.col("sample_id") % 3
    said = F.when(n == 0, "(B) here").when(F.col("sample_id") % 5 == 4, "").otherwise("a, not (B)")
    return grounding.grounded_choice(views.grounding(spark, d).withColumn("outcome", parse.leading_choice(said, F.lit("b"))))


DETECTION_SQL = """taus AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau), videos AS (SELECT g.video, n_gold, coalesce(n_pred, 0) AS n_pred FROM (SELECT video, count(*) AS n_gold FROM gold GROUP BY 1) g LEFT JOIN (SELECT video, count(*) AS n_pred FROM pred GROUP BY 1) USING (video)),
hits AS (SELECT video, tau, count(DISTINCT pred_i) AS hp, count(DISTINCT ref_i) AS hg FROM pairs JOIN taus ON iou > tau GROUP BY 1, 2),
each AS (SELECT tau, video, CASE WHEN n_pred = 0 THEN 0 ELSE coalesce(hp, 0) / n_pred END AS p, coalesce(hg, 0) / n_gold AS r FROM videos CROSS JOIN taus LEFT JOIN hits USING (video, tau)),
means AS (SELECT tau, count(*) AS videos, avg(p) AS p, avg(r) AS r FROM each GROUP BY tau),
detected AS (SELECT tau, videos, round(p, 5) AS precision, round(r, 5) AS recall, round(CASE WHEN p <= 0 OR r <= 0 THEN 0 ELSE 2 * p * r / (p + r) END, 5) AS f1 FROM means)"""


@query(f"WITH {views.SQL['dense']},\n{DETECTION_SQL} SELECT * FROM detected")
def a14_dvc_detection(spark, d):
    return dense.detection(*views.dense(spark, d))


@query(f"""WITH {views.SQL['dense']},\n{DETECTION_SQL}, k AS (SELECT (SELECT count(DISTINCT video) FROM pred) / count(DISTINCT conv_id) AS k FROM conversations)
SELECT tau, round(precision * k, 5) AS precision, round(recall * k, 5) AS recall, round(CASE WHEN precision <= 0 OR recall <= 0 THEN 0 ELSE 2 * precision * recall * k / (precision + recall) END, 5) AS f1 FROM detected, k""")
def a12_dvc_f1(spark, d):
    pred, gold = views.dense(spark, d)
    every = table(spark, d, "conversations").select(F.col("conv_id").alias("video"))
    return dense.scaled_f1(dense.detection(pred, gold), parsed=pred, samples=every)


@query(f"""WITH {views.SQL['dense']}, captions AS (SELECT row_number() OVER () AS sample_id, q.video AS source, p.sentence AS prediction, g.sentence AS reference FROM pairs q JOIN pred p ON p.video = q.video AND p.idx = q.pred_i JOIN gold g ON g.video = q.video AND g.idx = q.ref_i WHERE iou >= 0.3::DOUBLE),
{views.SQL['words']}, pooled AS (SELECT source AS video, n, sum(matched) AS m, sum(nc) AS nc, sum(nr) AS nr FROM counts JOIN captions USING (sample_id) GROUP BY 1, 2),
wide AS (SELECT video, coalesce(max(m) FILTER (n = 1), 0) AS m1, coalesce(max(m) FILTER (n = 2), 0) AS m2, max(nc) FILTER (n = 1) AS c1, max(nc) FILTER (n = 2) AS c2, max(nr) FILTER (n = 1) AS r1 FROM pooled GROUP BY 1),
bleu AS (SELECT video, CASE WHEN m1 = 0 THEN 0 ELSE pen * (m1 / c1) END AS b1, CASE WHEN m1 = 0 OR m2 = 0 THEN 0 ELSE pen * sqrt((m1 / c1) * (m2 / c2)) END AS b2 FROM (SELECT *, CASE WHEN c1 >= r1 THEN 1.0 ELSE exp(1 - r1 / c1) END AS pen FROM wide))
SELECT count(*) AS videos, round(avg(coalesce(b1, 0)), 5) AS bleu_1, round(avg(coalesce(b2, 0)), 5) AS bleu_2 FROM (SELECT DISTINCT video FROM gold) LEFT JOIN bleu USING (video)""")
def a15_dvc_caption_bleu(spark, d):
    pred, gold = views.dense(spark, d)
    met = dense.overlaps(pred, gold).filter("iou >= 0.3").select("video", "pred_i", "ref_i")
    side = lambda t, i, name: t.select("video", F.col("idx").alias(i), F.col("sentence").alias(name))
    pairs = met.join(side(pred, "pred_i", "prediction"), ["video", "pred_i"]).join(side(gold, "ref_i", "reference"), ["video", "ref_i"])
    pairs = pairs.withColumn("pair", F.concat_ws("/", "video", "pred_i", "ref_i"))
    own = captions.corpus_bleu(pairs, "video", "pair")
    every = gold.select("video").distinct().join(own, "video", "left")
    return every.agg(F.count("*").alias("videos"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 5).alias(c) for c in ("bleu_1", "bleu_2")])


@query()
def a15_dvc_caption_suite(spark, d):
    each = dense.caption_scores(*views.dense(spark, d))
    return each.agg(F.max("videos").alias("videos"), *[F.round(F.avg(c), 5).alias(c) for c in dense.SCORES])


SIMILARITY_SQL = """sets AS (SELECT 'p' AS side, video, idx, list_distinct(CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END) AS w FROM (SELECT video, idx, lower(trim(regexp_replace(sentence, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS t FROM pred)
  UNION ALL SELECT 'g', video, idx, list_distinct(CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END) FROM (SELECT video, idx, lower(trim(regexp_replace(sentence, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS t FROM gold)),
sims AS (SELECT q.video, q.pred_i, iou, CASE WHEN len(p.w) * len(g.w) = 0 THEN 0 ELSE len(list_intersect(p.w, g.w)) / sqrt(len(p.w) * len(g.w)) END AS sim FROM pairs q JOIN sets p ON p.side = 'p' AND p.video = q.video AND p.idx = q.pred_i JOIN sets g ON g.side = 'g' AND g.video = q.video AND g.idx = q.ref_i),
scored AS (SELECT tau, video, sim FROM sims JOIN taus ON iou >= tau UNION ALL SELECT tau, p.video, 0 FROM pred p, taus WHERE p.video IN (SELECT video FROM gold) AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.video = p.video AND q.pred_i = p.idx AND q.iou >= tau)),
alike AS (SELECT tau, avg(coalesce(sim, 0)) AS sim FROM (SELECT DISTINCT video FROM gold) CROSS JOIN taus LEFT JOIN (SELECT tau, video, avg(sim) AS sim FROM scored GROUP BY 1, 2) USING (tau, video) GROUP BY tau)"""


@query(f"WITH {views.SQL['dense']},\n{DETECTION_SQL},\n{SIMILARITY_SQL} SELECT tau, round(sim, 6) AS sim FROM alike")
def a15_dvc_caption_similarity(spark, d):
    """At each threshold: captions against those whose intervals they meet, and against none where they meet none; means over the videos."""
    return dense.caption_scores(*views.dense(spark, d)).select("tau", F.round("sim", 6).alias("sim"))


@query(f"""WITH {views.SQL['grounding']},\n{views.SQL['dense']},\n{DETECTION_SQL},\n{SIMILARITY_SQL},
parts AS (
  SELECT 'referring' AS metric, p_brand AS task, 's' AS source, round(avg(CASE WHEN p_partkey % 6 < 4 AND p_partkey % 6 = p_size % 4 THEN 1 ELSE 0 END), 5) AS value FROM part GROUP BY p_brand
  UNION ALL SELECT 'grounding', task, source, {_mean('x')} FROM (SELECT task, source, {_over(_FIRST, 'x')} FROM ious GROUP BY ALL)
  UNION ALL SELECT 'captioning', 'dvc', 's', round(avg(f1), 5) FROM detected UNION ALL SELECT 'captioning_similarity', 'dvc', 's', round(avg(sim), 5) FROM alike
  UNION ALL SELECT 'complex', task, source, {_mean('x')} FROM (SELECT task, source, {_over(_BEST, 'x')} FROM ious GROUP BY ALL))
SELECT coalesce(metric, 'OVERALL') AS metric, count(*) AS tasks, round(avg(value), 5) AS value FROM (SELECT metric, task, avg(value) AS value FROM parts GROUP BY 1, 2) GROUP BY ROLLUP (metric)""")
def a16_overall(spark, d):
    rows, (pred, gold) = views.grounding(spark, d), views.dense(spark, d)
    part = lambda frame, metric, c, task=None: frame.select(F.lit(metric).alias("metric"), F.lit(task).alias("task") if task else "task", F.col("source") if "source" in frame.columns else F.lit("s").alias("source"), F.col(c).alias("value"))
    mean = lambda frame, c: frame.agg(F.round(F.avg(c), 5).alias(c))
    every = part(a6_choice_letters(spark, d), "referring", "acc").union(part(grounding.first_span(rows), "grounding", "f1")).union(part(mean(dense.detection(pred, gold), "f1"), "captioning", "f1", "dvc"))
    every = every.union(part(mean(dense.caption_scores(pred, gold), "sim"), "captioning_similarity", "sim", "dvc")).union(part(grounding.event_match(rows), "complex", "mrec"))
    return grounding.overall(every)


# ---- head to head ----

COUNTS_SQL = "count(*) AS total, count(*) FILTER (success AND winner = 'A') AS a_wins, count(*) FILTER (success AND winner = 'B') AS b_wins, count(*) FILTER (success AND winner = 'tie') AS ties"


def _judged(spark, d):
    rows = views.verdicts(spark, d).select("sample_id", "category", jsons.verdict(F.col("verdict_json")).alias("v"))
    return rows.select("sample_id", "category", "v.winner", (F.col("v.status") == "ok").alias("success"))


@query(with_views("verdicts", then=f"""SELECT *, a_wins + b_wins + ties AS valid, total - a_wins - b_wins - ties AS errors, round(a_wins / (a_wins + b_wins + ties), 5) AS win_rate_a, round(b_wins / (a_wins + b_wins + ties), 5) AS win_rate_b,
  round(ties / (a_wins + b_wins + ties), 5) AS tie_rate FROM (SELECT {COUNTS_SQL} FROM verdicts)"""))
def a25_ab_win_rate(spark, d):
    return judging.win_rates(_judged(spark, d))


@query(with_views("verdicts", then=f"SELECT *, round(a_wins / total, 5) AS a_rate, round(b_wins / total, 5) AS b_rate, round(ties / total, 5) AS tie_rate FROM (SELECT coalesce(category, 'OVERALL') AS category, {COUNTS_SQL} FROM verdicts WHERE success GROUP BY ROLLUP (category))"))
def a26_ab_by_category(spark, d):
    return judging.win_rates_by_category(_judged(spark, d))


PAIR_COUNTS = "count(*) AS total, count(*) FILTER (winner = 'Model A') AS a_wins, count(*) FILTER (winner = 'Model B') AS b_wins, count(*) FILTER (winner = 'Tie') AS ties, round(avg(confidence), 5) AS mean_confidence"


@query(f"WITH {PAIRWISE_SQL} SELECT *, round(a_wins / total, 5) AS a_rate, round(b_wins / total, 5) AS b_rate, round(ties / total, 5) AS tie_rate FROM (SELECT category, {PAIR_COUNTS} FROM replies GROUP BY category)")
def a27_pairwise_stats(spark, d):
    return judging.pairwise_stats(_replies(spark, d), "category")


# ---- captions ----


@query(with_views("captions", "words", then="SELECT w AS word, count(*) AS df FROM (SELECT DISTINCT sample_id, unnest(r) AS w FROM words) GROUP BY w"))
def a28_doc_freq(spark, d):
    return captions.document_frequency(views.captions(spark, d))


BLEU_SQL = """wide AS (SELECT sample_id, coalesce(max(matched) FILTER (n = 1), 0) AS m1, coalesce(max(matched) FILTER (n = 2), 0) AS m2, coalesce(max(matched) FILTER (n = 3), 0) AS m3, coalesce(max(matched) FILTER (n = 4), 0) AS m4,
  coalesce(max(nc) FILTER (n = 1), 0) AS c1, coalesce(max(nc) FILTER (n = 2), 0) AS c2, coalesce(max(nc) FILTER (n = 3), 0) AS c3, coalesce(max(nc) FILTER (n = 4), 0) AS c4, coalesce(max(nr) FILTER (n = 1), 0) AS r1 FROM counts GROUP BY 1),
z AS (SELECT *, CAST(m1 = 0 AS INTEGER) AS z1, CAST(m1 = 0 AS INTEGER) + CAST(m2 = 0 AS INTEGER) AS z2, CAST(m1 = 0 AS INTEGER) + CAST(m2 = 0 AS INTEGER) + CAST(m3 = 0 AS INTEGER) AS z3, CAST(m1 = 0 AS INTEGER) + CAST(m2 = 0 AS INTEGER) + CAST(m3 = 0 AS INTEGER) + CAST(m4 = 0 AS INTEGER) AS z4 FROM wide),
s AS (SELECT sample_id, CASE WHEN m1 = 0 OR (c1 <= 1 AND m2 = 0) THEN 0 ELSE (CASE WHEN c1 > r1 THEN 1.0 ELSE exp(1 - r1 / c1) END) * exp((ln(m1 / c1)
  + ln((CASE WHEN m2 > 0 THEN m2 ELSE ln(c1) / (pow(2, z2) * 5) END) / greatest(1, c2)) + ln((CASE WHEN m3 > 0 THEN m3 ELSE ln(c1) / (pow(2, z3) * 5) END) / greatest(1, c3)) + ln((CASE WHEN m4 > 0 THEN m4 ELSE ln(c1) / (pow(2, z4) * 5) END) / greatest(1, c4))) / 4) END AS bleu FROM z)"""


@query(f"WITH {views.SQL['captions']},\n{views.SQL['words']},\n{BLEU_SQL} SELECT sample_id, coalesce(round(bleu, 6), 0) AS bleu FROM captions LEFT JOIN s USING (sample_id)")
def x1_bleu(spark, d):
    return captions.bleu(views.captions(spark, d), "sample_id")


@query(with_views("captions", "words", then="SELECT sample_id, n, coalesce(round(CASE WHEN matched = 0 THEN 0 ELSE 2 * matched / (nc + nr) END, 6), 0) AS rouge FROM (SELECT sample_id, unnest([1, 2]) AS n FROM captions) LEFT JOIN counts USING (sample_id, n)"))
def x2_rouge12(spark, d):
    return captions.rouge_n(views.captions(spark, d), "sample_id", (1, 2))


def _pooled_sql() -> str:
    """BLEU-1 to BLEU-4 of each source's summed counts."""
    wide = ", ".join(f"coalesce(max(m) FILTER (n = {n}), 0) AS m{n}, coalesce(max(nc) FILTER (n = {n}), 0) AS c{n}" for n in (1, 2, 3, 4))
    some = lambda n: " AND ".join(f"m{k} > 0" for k in range(1, n + 1))
    logs = lambda n: " + ".join(f"ln(m{k} / c{k})" for k in range(1, n + 1))
    scores = ", ".join(f"CASE WHEN {some(n)} THEN round((CASE WHEN c1 >= r1 THEN 1.0 ELSE exp(1 - r1 / c1) END) * exp(({logs(n)}) / {n}), 6) ELSE 0.0 END AS bleu_{n}" for n in (1, 2, 3, 4))
    return f"""pooled AS (SELECT source, n, sum(matched) AS m, sum(nc) AS nc, sum(nr) AS nr FROM counts JOIN captions USING (sample_id) GROUP BY 1, 2),
wide AS (SELECT source, coalesce(max(nr) FILTER (n = 1), 0) AS r1, {wide} FROM pooled GROUP BY 1) SELECT source, {scores} FROM wide"""


@query(f"WITH {views.SQL['captions']},\n{views.SQL['treebank']},\n{_pooled_sql()}")
def x5_treebank_bleu(spark, d):
    """BLEU over the tokens of caption scores, by source."""
    own = captions.corpus_bleu(views.captions(spark, d), "source", "sample_id", split=text.treebank)
    return own.select("source", *[F.round(f"bleu_{n}", 6).alias(f"bleu_{n}") for n in (1, 2, 3, 4)])


@query()
def x2_rouge_stemmed(spark, d):
    return captions.stemmed_rouge(views.captions(spark, d), "sample_id")


@query(with_views("captions", "words", then="""SELECT sample_id, coalesce(round(lo / hi, 6), 0) AS cider FROM captions LEFT JOIN (
  SELECT sample_id, sum(least(c, f) / (1 + coalesce(df, 1))) AS lo, sum(greatest(c, f) / (1 + coalesce(df, 1))) AS hi FROM grams
  LEFT JOIN (SELECT w, count(*) AS df FROM (SELECT DISTINCT sample_id, unnest(r) AS w FROM words) GROUP BY w) ON w = string_split(gram, ' ')[1] WHERE n = 4 GROUP BY sample_id) USING (sample_id)"""))
def x3_cider_lite(spark, d):
    return captions.cider_lite(views.captions(spark, d), "sample_id")


@query(f"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS t FROM documents), w AS (SELECT doc_id, t, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM t)
SELECT doc_id AS sample_id, CASE WHEN t = '' THEN 0 ELSE round(0.3::DOUBLE * least(1.0::DOUBLE, len(w) / 50) + 0.4::DOUBLE * least(1.0::DOUBLE, len(list_intersect(w, {text.OBJECT_WORDS})) / 10) + 0.3::DOUBLE * least(1.0::DOUBLE, len([x FOR x IN {text.RELATION_PHRASES} IF contains(t, x)]) / 5), 6) END AS score FROM w""")
def x4_dsg_lite(spark, d):
    return captions.scene_scores(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("prediction")), "sample_id")


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(lower(trim(regexp_replace(d.text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))), ' ')) AS p, list_distinct(string_split(lower(trim(regexp_replace(b.text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))), ' ')) AS r
  FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)
SELECT doc_id AS sample_id, round(len(list_intersect(p, r)) / sqrt(len(p) * len(r)), 6) AS sim FROM w""")
def x6_sentence_similarity(spark, d):
    return views.captions(spark, d).select("sample_id", F.round(captions.hashed_similarity(F.col("prediction"), F.col("reference")), 6).alias("sim"))


# ---- reports, frames, keys ----


@query(with_views("cube", then="SELECT string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, string_agg(DISTINCT evaluator, ',' ORDER BY evaluator) AS evaluators, count(*) AS results FROM cube"))
def a29_results_cube(spark, d):
    return report.contents(views.cube(spark, d))


@query(with_views("cube", then="SELECT model, " + ", ".join(f"coalesce(printf('%.4f', max(value) FILTER (dataset = '{a}' AND evaluator = '{b}')), 'N/A') AS {a}_{b}" for a in ("de", "en", "es", "fr") for b in ("quality", "toxic")) + " FROM cube GROUP BY model"))
def k8_report_pivot(spark, d):
    return report.pivot(views.cube(spark, d))


@query(with_views("cube", then="SELECT evaluator, score, row_number() OVER (ORDER BY score DESC, evaluator) AS place FROM (SELECT model || '/' || evaluator AS evaluator, round(avg(value), 5) AS score FROM cube GROUP BY 1)"))
def a30_method_rank(spark, d):
    rows = views.cube(spark, d).groupBy(F.concat_ws("/", "model", "evaluator").alias("evaluator")).agg(F.round(F.avg("value"), 5).alias("score"))
    return report.ranking(rows)


@query("""SELECT p_partkey AS part, unnest(['linspace', 'stride', 'rounded']) AS scheme, unnest([
  CASE WHEN p_size <= 8 THEN array_to_string(range(p_size), ',') ELSE array_to_string([CAST(floor(i * (p_size - 1) / 7) AS INTEGER) FOR i IN range(8)], ',') END,
  CASE WHEN p_size <= 8 THEN array_to_string(range(p_size), ',') ELSE array_to_string([CAST(floor(i * p_size / 8) AS INTEGER) FOR i IN range(8)], ',') END,
  CASE WHEN p_size <= 8 THEN array_to_string(range(p_size), ',') ELSE array_to_string([CAST(round_even(i * (p_size - 1) / 7, 0) AS INTEGER) FOR i IN range(8)], ',') END]) AS indices FROM part""")
def m6_frame_indices(spark, d):
    n = F.col("p_size")
    schemes = {"linspace": temporal.linspace_frames(n, 8), "stride": temporal.stride_frames(n, 8), "rounded": temporal.rounded_frames(n, 8)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), F.array_join(v.cast("array<string>"), ",").alias("indices")) for k, v in schemes.items()])).alias("x")
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), each).select("part", "x.scheme", "x.indices")


@query("""SELECT 'model_' || o_orderstatus || '_' || substr(md5('{"priority": "' || o_orderpriority || '"}'), 1, 8) AS key, count(*) AS n FROM orders GROUP BY 1""")
def m8_cache_key(spark, d):
    config = F.concat(F.lit('{"priority": "'), F.col("o_orderpriority"), F.lit('"}'))
    return table(spark, d, "orders").groupBy(temporal.cache_key(F.lit("model"), F.col("o_orderstatus"), config).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 25")
def l1_max_samples(spark, d):
    return table(spark, d, "documents").orderBy(F.col("doc_id").cast("string")).limit(25).select("doc_id", "source")
