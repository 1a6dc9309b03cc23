"""Compare a query's rows with its SQL's, order aside."""

import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


def same(spark, con, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
