"""Compares a Spark query with DuckDB SQL over the same tables."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = [names.index(c) for c in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = query(spark, sf_dir)
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, answer.fetchall())
