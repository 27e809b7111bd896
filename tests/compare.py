"""Run a registered query on Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql) -> str | None:
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} vs {dc}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = {d[0]: str(d[1]) for d in con.execute(sql).description}
    odd = [
        (c, types[c], duck_types[c]) for c in sc
        if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        .get(types[c], duck_types[c]) != duck_types[c]
    ]
    if sr != dr:
        only_s = [r for r in sr if r not in set(dr)][:3]
        only_d = [r for r in dr if r not in set(sr)][:3]
        return f"rows {len(sr)} vs {len(dr)}; spark only {only_s}; sql only {only_d}; types {odd}"
    if odd:
        return f"types {odd}"
    return None
