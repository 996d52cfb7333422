"""Local stand-in for the driver's gate: run a Spark query and its DuckDB SQL on the
same test tables and compare row count, column names and sorted values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits=9):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(v) if digits is None else f"{round(v, digits):.{digits}g}")
    if hasattr(v, "isoformat"):
        s = v.isoformat().replace("T", " ")
        return (1, s.split("+")[0])
    return (1, str(v))


def compare(spark, name, q, sql, sf_dir, digits=None):
    t = time.time()
    sdf = q(spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    st = time.time() - t
    scols = sorted(sdf.columns)
    con = duck(sf_dir)
    t = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    dt = time.time() - t
    res = {"name": name, "spark_rows": len(srows), "duck_rows": len(drows), "spark_s": round(st, 2),
           "duck_s": round(dt, 3)}
    if scols != sorted(dcols):
        res["error"] = f"columns differ: {scols} vs {sorted(dcols)}"
        return res
    key = lambda r: tuple(_norm(r[c], digits) for c in scols)
    a = sorted(key(r) for r in srows)
    b = sorted(key(r) for r in drows)
    res["match"] = a == b
    if not res["match"]:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["first_diffs"] = diffs
    return res
