"""Spark query vs DuckDB oracle, the way the driver compares them:
row count, column names, and order-insensitive values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"   # compare floats bit for bit


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


SPARK_TYPES = {"bigint": "i64", "int": "i32", "smallint": "i16", "double": "f64", "float": "f32",
               "string": "str", "boolean": "bool"}
DUCK_TYPES = {"BIGINT": "i64", "INTEGER": "i32", "SMALLINT": "i16", "DOUBLE": "f64", "FLOAT": "f32",
              "VARCHAR": "str", "BOOLEAN": "bool"}


def types_match(sdf, cur):
    s = {n: SPARK_TYPES.get(t, t) for n, t in sdf.dtypes}
    d = {c[0]: DUCK_TYPES.get(str(c[1]), str(c[1])) for c in cur.description}
    bad = {n: (s.get(n), d.get(n)) for n in s if s.get(n) != d.get(n)}
    return not bad, bad


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    ok_types, bad_types = types_match(sdf, cur)
    ok_cols = sorted(s_cols) == sorted(d_cols) and ok_types
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
    detail = ""
    if not ok_v:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        detail = (f"cols spark={sorted(s_cols)} duck={sorted(d_cols)} types={bad_types} "
                  f"n={len(s_rows)}/{len(d_rows)} diff={diff}")
    return ok_cols and ok_n and ok_v, round(t1 - t0, 2), round(t2 - t1, 2), detail


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from tardy.session import get_session
    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    names = argv[1:] or list(E.queries())
    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        if n not in sqls:
            df = qs[n](spark, sf_dir)
            print(f"{n:28s} NO-ORACLE rows={df.count()}")
            continue
        try:
            ok, ts, td, detail = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, ts, td, detail = False, 0, 0, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} spark={ts}s duck={td}s {detail}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
