"""Run registered queries next to their oracle SQL and compare values.

    python tests/oracle.py [--sf 0.01] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def make_session():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="oracle-", dir="/tmp")
    return (SparkSession.builder.master("local[8]").appName("oracle").config("spark.checkpoint.dir", shared)
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.clauseloom.readPartitions", "8").config("spark.driver.extraJavaOptions", "-Xss8m")
            .getOrCreate())


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 9))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        a, b = set(got), set(want)
        return False, (f"{len(got)} vs {len(want)} rows; cols {sorted(cols)}; only spark {sorted(a - b)[:3]}; "
                       f"only sql {sorted(b - a)[:3]}")
    return True, f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from __spark_entry__ import oracle_sql, queries

    spark = make_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    names = [n for n in qs if not args.names or any(n.startswith(a) for a in args.names)]
    bad = 0
    for name in names:
        if args.explain:
            print("==", name)
            qs[name](spark, sf_dir).explain("formatted")
            continue
        try:
            ok, note = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
