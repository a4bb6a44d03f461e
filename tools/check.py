"""Run registered queries and compare each with its DuckDB twin.

    python tools/check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quarrywork.plans import load_all  # noqa: E402
from quarrywork.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if value != int(value) or abs(value) > 1e15 else repr(float(int(value)))
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 1 << 53 else str(value)
    if isinstance(value, dict):
        return str(sorted((str(k), norm(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([norm(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t)
    )


def compare(name: str, spark, sf_dir: str, con) -> tuple[bool, str]:
    q = load_all()[name]
    start = time.time()
    df = q.build(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if q.sql is None:
        return True, f"{len(got)} rows, no SQL twin, {took:.2f}s"
    start = time.time()
    cur = con.execute(q.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    sql_took = time.time() - start
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        only_got = sorted(set(got) - set(want), key=str)[:3]
        only_want = sorted(set(want) - set(got), key=str)[:3]
        return False, f"rows {len(got)} vs {len(want)}\n   spark  {str(only_got)[:900]}\n   duckdb {str(only_want)[:900]}"
    return True, f"{len(got)} rows equal, spark {took:.2f}s duckdb {sql_took:.2f}s"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--module", default=None)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    registry = load_all()
    names = args.names or list(registry)
    if args.module:
        names = [n for n in names if registry[n].build.__module__.endswith(args.module)]
    bad = 0
    for name in names:
        try:
            ok, note = compare(name, spark, args.sf, con)
        except Exception as error:  # report and carry on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + "  " + note, flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
