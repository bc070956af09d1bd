import pytest
from oracle import check

from scorelake.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    check(QUERIES[name], ORACLES[name], spark, DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_on_whole_tables(spark, name):
    source = "pages" if name.startswith("op4_") else "documents"
    rows = spark.read.parquet(f"{DIR}/{source}.parquet").count()
    got = QUERIES[name](spark, DIR)
    assert got.count() >= rows if name.startswith("op7_") else got.count() == rows
