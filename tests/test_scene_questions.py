"""Scene questions on odd lines, against the query's SQL."""

from oracle import check

from scorelake.plans.catalogue import ORACLES, QUERIES

TEXTS = [
    "0 | zero\n1 | one | 1\n22 | two | 2",  # digits that are their lines' places
    "  a | b  \n\ta | c\t\na | b\n\u00a0a | d\u3000\na | e \r\nno pipe",
    "x | No Mention\nNO MENT\u0130ON | y\n| \n|",
    "",
    None,
]


def test_same_as_sql(spark, tmp_path):
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (0, "0 | zero")]  # a document that comes again
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    check(QUERIES["e4_distinct_questions"], ORACLES["e4_distinct_questions"], spark, str(tmp_path))
