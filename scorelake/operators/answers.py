"""Accuracy of short answers: yes/no, digits, options, scene questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.functions.temporal import ratio

OVERALL = "OVERALL"
#: Unicode's spaces (category Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def zipped(rows: DataFrame, *arrays: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each position that all arrays have, with pos from 0; longer ones are cut off."""
    n = F.least(*[F.size(a) for a in arrays])
    cut = F.arrays_zip(*[F.slice(a, F.lit(1), F.greatest(n, F.lit(0))).alias(a) for a in arrays])
    return rows.select(*keep, F.posexplode(cut).alias("pos", "item")).select(*keep, "pos", *[F.col(f"item.{a}").alias(a) for a in arrays])


def pair_accuracy(rows: DataFrame, by: str = "task") -> DataFrame:
    """Of pairs (a basic and a hallucinated question): accuracy of each, and of both at once, by task. An answer is right if it has the reference as a whole word; one whose reference is no pattern takes no part in its own mean, and the pair in none of both."""
    hit = lambda i: text.has_word(F.col("prediction")[i], F.col("reference")[i])
    marked = rows.filter(F.coalesce(F.col(by), F.lit("")) != "").select(by, hit(0).alias("basic_hit"), hit(1).alias("halluc_hit"))
    share = lambda c: F.round(F.avg(c.cast("int")), 5)
    return marked.groupBy(by).agg(F.count("*").alias("n"), share(F.col("basic_hit")).alias("basic"), share(F.col("halluc_hit")).alias("halluc"), share(F.col("basic_hit") & F.col("halluc_hit")).alias("both"))


def _fine(rows: DataFrame) -> DataFrame:
    return rows.filter("error is null") if "error" in rows.columns else rows


def macro(rows: DataFrame, *columns: str) -> DataFrame:
    """Unweighted means of columns over rows of tasks; a null counts as 0. Tasks with an error, if rows have such a column, take no part."""
    return _fine(rows).agg(F.count("*").alias("tasks"), *[F.round(F.avg(F.coalesce(F.col(c), F.lit(0.0))), 5).alias(c) for c in columns])


def prefix_accuracy(rows: DataFrame, by: str = "task") -> DataFrame:
    """Of yes/no answers by their beginning: right, all and unread ones for each task, with rates. reference is `Yes.` or `No.`."""
    read = zipped(rows, "reference", "prediction", keep=(by,)).withColumn("answer", text.answer_prefix(F.col("prediction")))
    counts = read.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("answer") == F.col("reference")).alias("correct"), F.count_if(F.col("answer").isNull()).alias("unread"))
    return counts.withColumns({"acc": F.round(ratio(F.col("correct"), F.col("total")), 5), "not_match": F.round(ratio(F.col("unread"), F.col("total")), 5)})


def micro(rows: DataFrame, correct: str = "correct", total: str = "total") -> DataFrame:
    """Sums over tasks and their ratio; tasks with an error, if rows have such a column, take no part."""
    summed = _fine(rows).agg(F.sum(correct).alias("correct"), F.sum(total).alias("total"))
    return summed.withColumn("acc", F.round(ratio(F.col("correct"), F.col("total")), 5))


def digit_accuracy(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """One row: questions, those answered with an allowed digit, those right, and the accuracy over all."""
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col("prediction").isin(allowed)).alias("answered"), F.count_if(F.col("prediction").isin(allowed) & (F.col("prediction") == F.col("reference"))).alias("correct"))
    return counts.withColumn("acc", F.round(ratio(F.col("correct"), F.col("total")), 5))


def option_accuracy(rows: DataFrame, by: str = "task") -> DataFrame:
    """By task with an OVERALL row: answered if the prediction is among the options, right if it is the one at the gold index (from 0)."""
    answered = F.array_contains("options", F.col("prediction"))
    right = answered & (F.col("prediction") == F.get(F.col("options"), F.col("answer")))
    rolled = rows.rollup(by).agg(F.grouping(by).alias("whole"), F.count("*").alias("total"), F.count_if(answered).alias("answered"), F.count_if(right).alias("correct"))
    named = rolled.withColumn(by, F.when(F.col("whole") == 1, OVERALL).otherwise(F.col(by))).drop("whole")
    return named.withColumns({"acc": F.round(ratio(F.col("correct"), F.col("total")), 5), "answered_rate": F.round(ratio(F.col("answered"), F.col("total")), 5)})


def scene_answers(rows: DataFrame, by: str) -> DataFrame:
    """By sample: questions, those answered, yes, no and unclear, with rates over all; clarity is the share of yes and no. rows has status and raw_answer."""
    read = rows.withColumn("said", F.when(F.col("status") == "success", text.yes_no(F.col("raw_answer"))))
    counts = read.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("answered"), F.count_if(F.col("said")).alias("n_yes"), F.count_if(~F.col("said")).alias("n_no"))
    return rates(counts.withColumn("n_unclear", F.col("answered") - F.col("n_yes") - F.col("n_no")))


def scene_overall(rows: DataFrame, by: str) -> DataFrame:
    own = scene_answers(rows, by)
    return rates(own.agg(F.count("*").alias("samples"), *[F.sum(c).alias(c) for c in ("total", "answered", "n_yes", "n_no", "n_unclear")]))


def rates(counts: DataFrame) -> DataFrame:
    share = lambda c: F.round(ratio(c, F.col("total")), 4)
    return counts.withColumns({"yes_rate": share(F.col("n_yes")), "no_rate": share(F.col("n_no")), "clarity": share(F.col("n_yes") + F.col("n_no"))})


def scene_questions(lines: Column) -> Column:
    """Questions of a scene graph's text: its lines with a pipe, without those that mention nothing, without spaces at their ends, one each, first come first."""
    some = F.filter(piped_lines(lines), lambda x: ~F.contains(F.lower(F.translate(x, "\u0130", "i")), F.lit("no mention")))
    # F.trim itself would be handed each line's index as the characters to trim
    return F.array_distinct(F.transform(some, lambda x: F.trim(x, F.lit(SPACES))))


def piped_lines(lines: Column) -> Column:
    return F.filter(F.split(lines, "\n"), lambda x: F.contains(x, F.lit("|")))


def entity_names(lines: Column) -> Column:
    """The entities of a scene graph's first lines, `id | entity`, comma-joined: what stands after the first pipe, but for the first two lines, which are background and camera."""
    named = F.slice(piped_lines(lines), F.lit(3), F.greatest(F.lit(0), F.size(piped_lines(lines)) - 2))
    return F.array_join(F.transform(named, lambda x: F.trim(F.get(F.split(x, r"\|"), 1))), ", ")


def choice_accuracy(rows: DataFrame, by: str) -> DataFrame:
    """Referring accuracy: total, failed and hit share of struct column outcome(hit, failed)."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("outcome.failed")).alias("failed"), F.round(F.avg(F.col("outcome.hit").cast("int")), 5).alias("acc"))
