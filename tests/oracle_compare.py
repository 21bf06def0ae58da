"""Compare a registered query with its SQL on the same parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
