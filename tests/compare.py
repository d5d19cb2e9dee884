"""Compare registered queries with their SQL in DuckDB: same columns, kinds, rows and values."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, decimal.Decimal):
        return "decimal"
    if isinstance(value, dt.datetime):
        return "timestamp"
    return type(value).__name__


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got_names, got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want_names, want = normal(cur.fetchall(), [d[0] for d in cur.description])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            bad = sum(repr(a) != repr(b) for a, b in zip(got, want))
            return f"{bad} rows differ, first {g} != {w} ({got_names})"
    kinds = [{kind(r[i]) for r in got if r[i] is not None} for i in range(len(got_names))]
    wanted = [{kind(r[i]) for r in want if r[i] is not None} for i in range(len(got_names))]
    return None if kinds == wanted else f"kinds {kinds} != {wanted}"


def main(sf_dir: str, names: list[str]) -> int:
    from tickloom.plans import ORACLES, QUERIES
    from tickloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failures = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            if name in ORACLES:
                problem = difference(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                problem = None if QUERIES[name](spark, sf_dir).collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        label = "ok  " if problem is None else "FAIL"
        print(f"{label} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
