"""Compares a registered query with its SQL run by DuckDB over the same tables."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def connect(data):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(rows):
    return sorted(tuple(map(_plain, r)) for r in rows)


def compare(spark, data, query, sql):
    df = query(spark, data)
    cols = sorted(df.columns)
    mine = rows_of(df.select(*[f"`{c}`" for c in cols]).collect())
    got = connect(data).execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == rows_of([[r[i] for i in at] for r in got.fetchall()])
