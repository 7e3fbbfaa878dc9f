"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def differences(spark, name, query, sql, sf_dir, most=5):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    assert names == sorted(theirs), f"{name}: columns {names} and {sorted(theirs)}"
    a = sorted((tuple(_norm(r[c]) for c in names) for r in (x.asDict(recursive=True) for x in got.collect())), key=repr)
    order = [theirs.index(c) for c in names]
    b = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if a == b:
        return len(a), []
    return len(a), [f"{name}: {len(a)} and {len(b)} rows", *[f"spark {x}" for x in a if x not in set(b)][:most], *[f"duckdb {x}" for x in b if x not in set(a)][:most]]
