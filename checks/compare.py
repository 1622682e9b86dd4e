"""Compare the registered queries with their SQL, from the command line.

    python -m checks.compare /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.registry import QUERIES
from shopgrain.session import build_session

# DuckDB type -> Spark type name as printed by simpleString.
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _value(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.isoformat()
    return x


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, key: str) -> str:
    """'' if rows, names and types agree, else what differs."""
    df = QUERIES[key](spark, folder)
    names = sorted(df.columns)
    ours = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    rel = con.sql(ORACLE[key])
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    spark_types = dict(df.dtypes)
    for name, dtype in zip(rel.columns, rel.types):
        if TYPES.get(str(dtype), str(dtype)) != spark_types[name]:
            return f"type of {name}: {spark_types[name]} vs {dtype}"
    at = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(_value(r[i]) for i in at) for r in rel.fetchall())
    if ours != theirs:
        a, b = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{ours.total()} vs {theirs.total()} rows; ours {a} theirs {b}"
    return "" if ours else "empty"


def main(argv: list[str]) -> int:
    folder, keys = argv[0], argv[1:] or list(QUERIES)
    settings = {"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false"}
    spark = build_session("local[8]", "checks", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    for key in keys:
        started = time.time()
        try:
            problem = compare(spark, con, folder, key) if key in ORACLE else "no SQL"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - started:6.2f}s {key} {problem}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
