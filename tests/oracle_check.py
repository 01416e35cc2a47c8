"""Compares the registered queries with their SQL in DuckDB: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return None if math.isnan(f) else 0.0 if f == 0 else f
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def compare(frame, relation) -> str:
    """Empty if both have the same columns and rows."""
    names = [d[0] for d in relation.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in order) for r in frame.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:2]}; only in SQL {list((b - a).items())[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql, con, bad = entry.oracle_sql(), connect(sf_dir), 0
    for name, f in entry.queries().items():
        if name in sql and (not sys.argv[2:] or name in sys.argv[2:]):
            began = time.time()
            try:
                said = compare(f(spark, sf_dir), con.execute(sql[name]))
            except Exception as e:
                said = f"{type(e).__name__}: {str(e)[:400]}"
            bad += bool(said)
            if said:
                print(f"{name} {time.time() - began:.1f} s {said[:700]}", flush=True)
    print("differing:", bad, "of", len(sql))
