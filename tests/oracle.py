"""Compare a Spark query with its SQL on DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import collections
import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql):
    res = con.execute(sql)
    duck_cols = [c[0] for c in res.description]
    duck = multiset(duck_cols, res.fetchall())
    spark = multiset(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(duck_cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(duck_cols)}")
    if duck != spark:
        problems.append(
            f"rows {sum(spark.values())} vs {sum(duck.values())}; "
            f"only spark {list((spark - duck).items())[:2]}; only sql {list((duck - spark).items())[:2]}"
        )
    return sum(spark.values()), problems
