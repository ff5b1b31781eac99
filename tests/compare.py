"""Run registered queries next to their SQL and compare all values.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def _order(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=_order)


def differences(spark, con, entry, folder: str) -> tuple[str | None, int, float, float]:
    """What differs (or None), the row count, and both times."""
    t0 = time.time()
    df = entry.run(spark, folder)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if entry.body is None:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(entry.sql())
    sql_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problem = None
    if names != sql_names:
        problem = f"columns {names} against {sql_names}"
    elif len(got) != len(want):
        problem = f"{len(got)} rows against {len(want)}"
    elif got != want:
        off = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
        problem = f"{len(off)} of {len(got)} rows differ, first {off[0][0]} against {off[0][1]}"
    return problem, len(got), t1 - t0, t2 - t1


def main() -> int:
    from landflux.plans import REGISTRY
    from landflux.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(REGISTRY)
    spark = local_session("compare", os.environ.get("BENCH_CPUS", "8"))
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            problem, n, ours, theirs = differences(spark, con, REGISTRY[name], folder)
        except Exception as error:  # shown, counted, and the next query goes on
            problem, n, ours, theirs = f"{type(error).__name__}: {' '.join(str(error).split())[:300]}", 0, 0.0, 0.0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        checked = "" if REGISTRY[name].body else " (rows only)"
        print(f"{mark} {name}{checked}: {n} rows, {ours:.2f}s, sql {theirs:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
