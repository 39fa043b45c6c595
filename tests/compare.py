"""Run registered queries in Spark and their SQL in DuckDB and compare by value."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "CartesianProduct" in plan:
        return took, len(got), "the plan pairs every row with every row"
    if sql is None:
        return took, len(got), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return took, len(got), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return took, len(got), f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return took, len(got), f"{sorted(cols)}\n   spark {x}\n   duck  {y}"
    return took, len(got), ""


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from timekeel.session import session

    sf = argv[0]
    wanted = argv[1:]
    spark = session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            took, n, verdict = compare(spark, con, fn, o.get(name), sf)
        except Exception as e:  # noqa: BLE001
            took, n, verdict = 0, 0, f"ERROR {type(e).__name__}: {str(e)[:900]}"
        if verdict is None:
            tag = "no-sql"
        elif verdict == "":
            tag = "ok"
        else:
            tag, bad = "BAD", bad + 1
        print(f"{tag:7}{took:7.2f}s {n:8d}  {name}", flush=True)
        if verdict:
            print("   " + verdict, flush=True)
    print(f"{bad} bad of {len(q)}")


if __name__ == "__main__":
    main(sys.argv[1:])
