"""Compares a query's rows with those of its SQL in DuckDB, as sorted lists."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    frame = query(spark, sf)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(frame.columns) == sorted(names), (frame.columns, names)
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    if mine == theirs:
        return len(mine)
    known, other = set(mine), set(theirs)
    only = [x for x in mine if x not in other][:3], [x for x in theirs if x not in known][:3]
    assert len(mine) == len(theirs), (len(mine), len(theirs), only)
    assert mine == theirs, only
    return len(mine)
