"""Run named queries against their SQL: ``python -m tickloom.plans.check [sf_dir] [pattern]``."""

from __future__ import annotations

import math
import re
import sys
import time

import duckdb

from tickloom.plans import catalog
from tickloom.plans.registry import QUERIES, full_sql, runner

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(value: object) -> object:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def compare(spark_df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    cols = sorted(spark_df.columns)
    rel = con.execute(f"SELECT * FROM ({sql}) t")
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    index = [names.index(c) for c in cols]
    want = [tuple(cell(r[j]) for j in index) for r in rel.fetchall()]
    got = [tuple(cell(r[c]) for c in cols) for r in spark_df.collect()]
    if len(want) != len(got):
        return f"rows spark {len(got)} vs sql {len(want)}"
    if not want:
        return "EMPTY"

    def order(r: tuple) -> tuple:
        return tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r)

    want.sort(key=order)
    got.sort(key=order)
    bad, near = 0, 0
    sample = None
    for a, b in zip(got, want, strict=True):
        if a == b and [type(x) for x in a] == [type(x) for x in b]:
            continue
        close = all(
            x == y
            or (isinstance(x, float) and isinstance(y, float)
                and math.isclose(x, y, rel_tol=1e-7, abs_tol=2e-6))
            for x, y in zip(a, b, strict=True)
        ) and [type(x) for x in a] == [type(x) for x in b]
        near += close
        if not close:
            bad += 1
            sample = sample or (a, b)
    if bad:
        diff = [(c, x, y) for c, x, y in zip(cols, *sample, strict=True) if x != y or type(x) is not type(y)]
        return f"{bad}/{len(want)} rows differ, e.g. {diff[:6]} at {sample[0][:4]}"
    if near:
        return f"ROUNDING {near}/{len(want)}"
    return ""


def main(argv: list[str]) -> int:
    from tickloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    pattern = argv[1] if len(argv) > 1 else "."
    catalog.load()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, q in QUERIES.items():
        if not re.search(pattern, name):
            continue
        started = time.time()
        try:
            df = runner(q)(spark, sf_dir)
            if q.sql is None:
                note = f"rows only: {df.count()}"
            else:
                note = compare(df, con, full_sql(q))
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__} {str(error)[:700]}"
        ok = note == "" or note.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
