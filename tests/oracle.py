"""Compare a query's rows with its oracle's, as multisets of values with types."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, f, sql, sf_dir):
    df = f(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    other = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(mine) == len(other), (len(mine), len(other), mine[:3], other[:3])
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    assert not bad, (len(bad), bad[:3])
    kinds = {n: str(t) for n, t in zip(names, (x[1] for x in cur.description))}
    ours = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    off = {n: (ours[n], kinds[n]) for n in names if same.get(ours[n], ours[n]) != kinds[n]}
    assert not off, off
    return len(mine)
