"""Oracle comparison used by the tests: run a registered query in Spark and its
SQL in DuckDB on the same Parquet tables; compare schema names, row count and
the multiset of rows (columns sorted by name, floats rounded)."""

from __future__ import annotations

import math

from kgflow.sources.tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, sf_dir: str, fn, sql: str, con=None):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in df.collect()])
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rows_of(d_cols, rel.fetchall())
    same = s_rows == d_rows
    diff = []
    if not same:
        from collections import Counter
        cs, cd = Counter(s_rows), Counter(d_rows)
        diff = list((cs - cd).elements())[:3] + ["|"] + list((cd - cs).elements())[:3]
    return {
        "schema": sorted(s_cols) == sorted(d_cols),
        "rows": len(s_rows) == len(d_rows),
        "values": same,
        "n_spark": len(s_rows), "n_oracle": len(d_rows),
        "spark_cols": s_cols, "oracle_cols": d_cols,
        "diff": diff,
    }
