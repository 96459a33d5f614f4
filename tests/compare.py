"""Run catalogue queries on Spark and their check SQL on DuckDB, and compare."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleaner.catalog import load  # noqa: E402
from gleaner.plans.derive import BASE  # noqa: E402


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, need_rows: bool = True) -> tuple[bool, str]:
    queries, checks = load()
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in checks:
        return bool(got) or not need_rows, f"rows={len(got)} (rows only)"
    cur = con.execute(checks[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((str(type(v)), str(v)) for v in r)
    got, want = sorted(map(key, got)), sorted(map(key, want))
    if got == want:
        return bool(got) or not need_rows, f"rows={len(got)} equal"
    extra = [g for g in got if g not in set(want)][:2]
    missing = [w for w in want if w not in set(got)][:2]
    return False, f"rows {len(got)} vs {len(want)}\n  spark {extra}\n  check {missing}"


if __name__ == "__main__":
    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    spark, con = spark_session(), duck(folder)
    picks = sys.argv[1:]
    queries, _ = load()
    bad = 0
    for name in queries:
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print("ok " if ok else "BAD", name, f"{time.time() - t:.1f}s", note, flush=True)
    print("failed:", bad)
