"""Run registered queries and compare them with their SQL: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, connection, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    got = table_rows(spark_df.columns, spark_df.collect())
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    want = table_rows(names, relation.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            bad = sum(x != y for x, y in zip(got, want, strict=True))
            return f"{bad} of {len(got)} rows differ, first {a} != {b}"
    types = [(n, t) for n, t in spark_df.dtypes]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    odd = [f"{n}:{t}/{kinds[n]}" for n, t in types if not _same_type(t, kinds[n])]
    return f"types {odd}" if odd else None


def _same_type(spark_type: str, duck_type: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    return pairs.get(spark_type, duck_type) == duck_type


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from rentlens.session import local_session

    spark = local_session("8")
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, folder)
            result = differences(df, connection, oracles[name]) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad = result is not None and not result.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.2f}s {result or ''}"[:1200], flush=True)
    print(f"{failed} failed of {len(names or queries)}")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(min(main(where, args), 1))
