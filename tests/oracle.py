"""Run a registered query and its oracle SQL on the same folder and compare the whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "integer": "int32", "bigint": "int64",
    "double": "float64", "float": "float32", "string": "text", "varchar": "text", "boolean": "bool",
    "timestamp": "time", "timestamp_ntz": "time", "date": "date", "blob": "bytes", "binary": "bytes",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value + 0.0, 9) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def compare(spark, con, query, sql, folder) -> tuple[list[str], int, float]:
    """Problems found (none when equal), row count, seconds of the Spark side."""
    start = time.time()
    df = query(spark, folder)
    spark_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = [str(t).lower() for t in con.sql(sql).types]
    duck_rows = res.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"], len(spark_rows), took
    spark_types, duck_types = dict(df.dtypes), dict(zip(names, types))
    for name in names:
        s, d = spark_types[name], duck_types[name]
        if KINDS.get(s.split("(")[0], s) != KINDS.get(d.split("(")[0], d):
            problems.append(f"type of {name}: {s} != {d}")
    order_s = [df.columns.index(n) for n in sorted(names)]
    order_d = [names.index(n) for n in sorted(names)]
    left = sorted(tuple(cell(r[i]) for i in order_s) for r in spark_rows)
    right = sorted(tuple(cell(r[i]) for i in order_d) for r in duck_rows)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        only_l = sorted(set(left) - set(right))[:3]
        only_r = sorted(set(right) - set(left))[:3]
        problems.append(f"values differ\n  columns {sorted(names)}\n  spark  {only_l}\n  oracle {only_r}")
    return problems, len(left), took


def main(folder: str, wanted: list[str]) -> int:
    from quillwork.plans import load_all
    from quillwork.registry import ORACLES, QUERIES
    from quillwork.session import build_session

    load_all()
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for key in sorted(QUERIES):
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if key in ORACLES:
                problems, rows, took = compare(spark, con, QUERIES[key], ORACLES[key], folder)
            else:
                start = time.time()
                df = QUERIES[key](spark, folder)
                problems, rows = [], len(df.collect())
                took = time.time() - start
                key += " (rows only)"
        except Exception as e:  # report and go on with the next query
            problems, rows, took = [f"{type(e).__name__}: {str(e)[:1500]}"], 0, 0.0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {key:36s} {rows:8d} rows {took:6.2f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
