"""Runs a query in both engines and compares its rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def same_rows(spark, query, sql, sf):
    got = query(spark, sf)
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{sf}/{t}.parquet')")
        want = con.sql(sql)
        names = want.columns
        want = normal(want.fetchall(), names)
    assert normal([tuple(r) for r in got.collect()], got.columns) == want
