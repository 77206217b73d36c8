"""Run a registered query and its SQL twin and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value).replace("+00:00", "")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def run_sql(sql: str, directory: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(directory, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    return rows_of([c[0] for c in cursor.description], cursor.fetchall())


def run_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
