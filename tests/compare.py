"""Run registered queries next to their SQL oracles and compare values.

    python tests/compare.py [name ...]      SF_DIR picks the data folder
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return "rows", f"{len(got)} rows", t1 - t0, 0.0
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want, want_cols = rows_of(cols, res.fetchall())
    t2 = time.time()
    if got_cols != want_cols:
        return "FAIL", f"columns {got_cols} vs {want_cols}", t1 - t0, t2 - t1
    if got != want:
        g, w = set(got) - set(want), set(want) - set(got)
        return "FAIL", f"{len(got)} vs {len(want)} rows; {got_cols}\n   got  {sorted(g)[:3]}\n   want {sorted(w)[:3]}", t1 - t0, t2 - t1
    return "ok", f"{len(got)} rows", t1 - t0, t2 - t1


def main(names):
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(sf_dir)
    bad = []
    for name, fn in queries.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            state, note, s, o = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            state, note, s, o = "ERROR", f"{type(e).__name__}: {str(e)[:700]}", 0.0, 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if state in ("FAIL", "ERROR"):
            bad.append(name)
        print(f"{state:5s} {name:34s} {s:6.2f}s {o:6.2f}s  {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
