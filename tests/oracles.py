"""Comparing a query's rows with its DuckDB statement's."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def same_rows(query, sql, spark, duck, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert got == want
