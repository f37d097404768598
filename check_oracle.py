"""Compare registered queries with their SQL: python check_oracle.py [sf_dir] [name ...].

With PLAIN_SESSION=1 the session has Spark's defaults instead of this package's settings.
"""

from __future__ import annotations

import decimal
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from sparkrag.catalog import load
from sparkrag.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain_session() -> SparkSession:
    return (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return sorted((str(k), plain(x)) for k, x in v.items())
    return str(v) if v is not None else None


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data), sorted(cols)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    queries, oracles = load()
    spark = plain_session() if os.environ.get("PLAIN_SESSION") else local_session(8, progress=False)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        try:
            t0 = time.time()
            df = fn(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in oracles:
                print(f"rows  {name}: {len(got[0])} rows {t1 - t0:.1f}s")
                continue
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            want = rows_of(cols, cur.fetchall())
            same = got == want
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got[0])}/{len(want[0])} rows "
                  f"{t1 - t0:.1f}s sql {time.time() - t1:.1f}s")
            if not same:
                print("   ", got[1], want[1])
                a, b = set(got[0]), set(want[0])
                print("    spark only", sorted(a - b)[:2], len(a - b))
                print("    sql only  ", sorted(b - a)[:2], len(b - a))
            types = {c: t for c, t in df.dtypes}
            odd = {c: (types.get(c), kinds[c]) for c in kinds
                   if types.get(c) and not close(types[c], kinds[c])}
            if odd:
                print("    types", odd)
        except Exception as exc:
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:1500]}")
        sys.stdout.flush()
    print("bad", bad)
    return bad


def close(spark_type: str, sql_type: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}
    return pairs.get(spark_type, sql_type) == sql_type


if __name__ == "__main__":
    sys.exit(main())
