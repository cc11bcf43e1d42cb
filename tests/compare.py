"""Compares a query's rows with its SQL's over the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.01"


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 5) + 0.0)
    if hasattr(x, "tolist"):
        return repr([cell(y) for y in x.tolist()])
    if isinstance(x, list):
        return repr([cell(y) for y in x])
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in data), sorted(columns)


def differences(spark, name, query, sql, sf_dir=SMALL):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = duck(sf_dir).sql(sql)
    want = rows(relation.columns, relation.fetchall())
    if got[1] != want[1]:
        return f"{name}: columns {got[1]} and {want[1]}"
    if got[0] != want[0]:
        extra = [x for x in got[0] if x not in set(want[0])][:3]
        lack = [x for x in want[0] if x not in set(got[0])][:3]
        return f"{name}: {len(got[0])} and {len(want[0])} rows; only ours {extra}; only SQL {lack}"
    return ""
