"""Run registered queries and compare them with their SQL in DuckDB: python verify.py [sf_dir] [name-part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from sparktick.session import build_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def canon(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v)) if not isinstance(v, int) or abs(v) < 2**53 else str(v)
    return str(v)


def rows_of(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canon(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    if sql is None:
        return ("rows-only" if got else "EMPTY"), len(got)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        kinds = {n: t for n, t in zip(names, (str(c[1]) for c in cur.description))}
        huge = [n for n, t in kinds.items() if "HUGEINT" in t]
        state = "ok" if a else "ok (empty)"
        return state + (f" HUGEINT {huge}" if huge else ""), len(got)
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"DIFF {len(a)} vs {len(b)} rows; cols {sorted(names)}\n   spark {only_a}\n   duck  {only_b}", len(got)


def main() -> int:
    from sparktick.queries import QUERIES, SQL

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = build_session(
        "verify", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            state, n = compare(spark, con, fn, SQL.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            state, n = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", 0
        bad += not (state.startswith("ok") or state == "rows-only")
        print(f"{name:38s} {time.time() - t:6.1f}s {n:7d} {state}", flush=True)
    print("not matching:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
