"""Run registered queries against their SQL on the same parquet tables.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    got, names = table([tuple(x) for x in df.collect()], df.columns)
    cur = con.execute(sql)
    want, expected = table(cur.fetchall(), [c[0] for c in cur.description])
    if names != expected:
        return f"columns {names} != {expected}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {dict(zip(names, bad[0][0]))} != {dict(zip(names, bad[0][1]))}"
    kinds = {(n, type(a), type(b)) for x, y in zip(got, want) for n, a, b in zip(names, x, y) if type(a) is not type(b)}
    return f"types {kinds}" if kinds else ""


def main() -> int:
    from eraloom.catalog import registry
    from eraloom.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf_dir, args = args[1], args[2:]
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name, (query, sql) in registry().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            note = compare(df, con, sql) if sql else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001 - report and go on
            note = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        ok = not note or note.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
