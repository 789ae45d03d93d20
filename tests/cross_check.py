"""Run registered queries on Spark and their SQL on DuckDB over the same files and compare.

    python -m tests.cross_check /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def duck(path: str):
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return f"{float(v):.9g}" if not isinstance(v, int) else f"{v}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    return names, sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(spark, con, name, q, path):
    t0 = time.time()
    df = q(spark, path)
    got = df.collect()
    t1 = time.time()
    if not q.sql:
        return f"rows-only {len(got)}", t1 - t0, 0.0
    res = con.execute(q.sql)
    dcols = [d[0] for d in res.description]
    dtypes = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    t2 = time.time()
    a, b = rows_of(df.columns, got), rows_of(dcols, want)
    note = ""
    types = dict(df.dtypes)
    odd = {k: (types.get(k), v) for k, v in dtypes.items() if _TYPES.get(v) != types.get(k)}
    if odd:
        note = f" types {odd}"
    if a[0] != b[0]:
        return f"BAD columns {a[0]} / {b[0]}", t1 - t0, t2 - t1
    if a[1] != b[1]:
        only_a = sorted(set(a[1]) - set(b[1]))[:2]
        only_b = sorted(set(b[1]) - set(a[1]))[:2]
        return f"BAD rows {len(got)} / {len(want)}\n   spark {only_a}\n   sql   {only_b}{note}", t1 - t0, t2 - t1
    return f"ok {len(got)}{note}" + ("  EMPTY" if not got else ""), t1 - t0, t2 - t1


if __name__ == "__main__":
    from colloquy.plans import QUERIES
    from colloquy.session import local_session

    path, picked = sys.argv[1], sys.argv[2:]
    import logging

    logging.disable(logging.CRITICAL)
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    con = duck(path)
    bad = 0
    for name, q in QUERIES.items():
        if picked and name not in picked and not any(name.startswith(p[:-1]) for p in picked if p.endswith("*")):
            continue
        try:
            verdict, s, d = compare(session, con, name, q, path)
        except Exception as e:  # noqa: BLE001
            verdict, s, d = f"BAD {type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += verdict.startswith("BAD")
        print(f"{name:32s} {s:6.2f}s {d:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
