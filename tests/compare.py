"""A Spark result against DuckDB's for the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def assert_same(df, sf_dir, sql):
    names, rows = oracle(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
