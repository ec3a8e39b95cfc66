"""Run registered queries and compare each with its SQL on DuckDB.

    python tools/check_catalog.py [SF_DIR] [NAME ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int]:
    """("ok" or what differs, number of rows)."""
    from catalog.registry import ORACLE, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return "no oracle", len(got)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} rows differ of {len(got)}, columns {sorted(cols)}: {bad[:2]}", len(got)
    return "ok", len(got)


def main() -> None:
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    from catalog.registry import QUERIES

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("STRANDLINE_SHARED", "/tmp/strandline-shared"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("STRANDLINE_CHUNKS"):
        spark.conf.set("strandline.chunks", os.environ["STRANDLINE_CHUNKS"])
    con = duck(sf_dir)
    failed = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            verdict, n = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += verdict != "ok"
        print(f"{name:28s} {n:8d} rows {time.time() - start:6.2f} s  {verdict}", flush=True)
    print(f"{failed} not ok")
    spark.stop()


if __name__ == "__main__":
    main()
