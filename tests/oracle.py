"""Runs a query and its SQL on the same tables and compares their rows."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect())


def expected(sql, folder):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(tuple(map(cell, r)) for r in con.sql(f"SELECT {names} FROM ({sql.rstrip().rstrip(';')}) q").fetchall())


def check(query, sql, spark, folder):
    assert rows_of(query(spark, folder)) == expected(sql, folder)
