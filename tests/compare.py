"""Run registered queries next to their SQL twins and compare the rows.

``python tests/compare.py [sf folder] [name ...]``
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, Decimal):
        return str(v)
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, name: str, query, oracle: str | None) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - started
    if oracle is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f} s"
    cur = con.execute(oracle)
    columns = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} but oracle {sorted(columns)}"
    if got != want:
        types = [(c, df.schema[c].dataType.simpleString()) for c in sorted(df.columns)]
        bad = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return False, f"{len(got)} rows, oracle {len(want)}; first difference {bad} {types}"
    bad_types = [c for g, w in zip(got[:1], want[:1]) for c, a, b in zip(sorted(columns), g, w) if type(a) is not type(b)]
    note = f" TYPES {bad_types}" if bad_types else ""
    return True, f"{len(got)} rows, {took:.1f} s{note}"


def main() -> None:
    from conftest import make_spark

    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark, con = make_spark(), connect(sf)
    failed = []
    oracles = oracle_sql()
    for name, q in queries().items():
        if args and name not in args:
            continue
        try:
            ok, text = compare(spark, con, sf, name, q, oracles.get(name))
        except Exception as e:  # report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {' '.join(failed)}")


if __name__ == "__main__":
    main()
