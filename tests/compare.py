"""Comparison of a query with its SQL in DuckDB: the same columns and the same rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def assert_same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(found.fetchall(), names)
