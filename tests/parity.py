"""Spark query vs DuckDB twin: row count, column names and an order-insensitive value
comparison. Used by the tests and runnable by hand:

    python tests/parity.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE"}


def types_of(sdf, con, sql):
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in sdf.schema.fields}
    dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {k: (st.get(k), dt.get(k)) for k in set(st) | set(dt) if st.get(k) != dt.get(k)}


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    # the twin must also hold as a view
    con.execute(f"CREATE OR REPLACE TEMP VIEW twin AS {sql}")
    rel = con.execute("SELECT * FROM twin")
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    scols = sdf.columns
    res = {"name": name, "spark_rows": len(srows), "duck_rows": len(drows),
           "columns_match": sorted(scols) == sorted(dcols), "spark_sec": round(t1 - t0, 2)}
    a, b = _rows(scols, srows), _rows(dcols, drows)
    res["values_match"] = res["columns_match"] and a == b
    res["type_diffs"] = types_of(sdf, con, sql)
    if not res["values_match"]:
        res["spark_cols"], res["duck_cols"] = sorted(scols), sorted(dcols)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["first_diffs"] = diff
    return res


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from shopscope.session import local_session, scratch_dir
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8, 8, scratch=scratch_dir())
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS-ONLY {name}: rows={n} sec={time.time()-t0:.2f}", flush=True)
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as e:  # report and continue
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        ok = r["values_match"] and r["spark_rows"] == r["duck_rows"] and not r["type_diffs"]
        bad += not ok
        print(("OK   " if ok else "FAIL ") + str(r), flush=True)
    print(f"failures: {bad}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
