"""Side-by-side run of a registered query and its SQL on the same parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, int):
        return v
    return type(v).__name__ == "Decimal" and round(float(v), 6) or str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_cell(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    order = [names.index(c) for c in cols]
    return cols, sorted((tuple(_cell(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def difference(df, sql, sf_dir):
    """None when equal, else a short account of the first difference."""
    c1, r1 = spark_rows(df)
    c2, r2 = duck_rows(connect(sf_dir), sql)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if r1 != r2:
        only1 = [r for r in r1 if r not in set(r2)][:3]
        only2 = [r for r in r2 if r not in set(r1)][:3]
        return f"rows {len(r1)} vs {len(r2)}; only spark {only1}; only sql {only2}"
    return None
