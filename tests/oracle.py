"""Compare a registered query with its SQL text on the given tables, value by value."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(data, key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, bool) else (False, "b", x) for x in t))


def compare(df, con, sql):
    spark_cols, spark_rows = normal(df.columns, df.collect())
    rel = con.execute(sql)
    duck_cols, duck_rows = normal([d[0] for d in rel.description], rel.fetchall())
    if spark_cols != duck_cols:
        return f"columns differ: {spark_cols} vs {duck_cols}", len(spark_rows)
    if len(spark_rows) != len(duck_rows):
        return f"row counts differ: {len(spark_rows)} vs {len(duck_rows)}", len(spark_rows)
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(spark_cols, a, b) if x != y]
            return f"first difference {diff[:4]} in {a}", len(spark_rows)
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types differ: {[(c, type(x), type(y)) for c, x, y in zip(spark_cols, a, b) if type(x) is not type(y)]}", len(spark_rows)
    return None, len(spark_rows)
