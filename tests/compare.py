"""Runs registered queries and their SQL side by side. As a script: compare.py SF_DIR [QUERY ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((value is None, str(type(value).__name__), value if value is not None else 0) for value in row)


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=_key)


def differences(left: tuple, right: tuple) -> list[str]:
    (left_columns, left_rows), (right_columns, right_rows) = left, right
    if left_columns != right_columns:
        return [f"columns {left_columns} / {right_columns}"]
    found = []
    if len(left_rows) != len(right_rows):
        found.append(f"rows {len(left_rows)} / {len(right_rows)}")
    for one, other in zip(left_rows, right_rows, strict=False):
        for name, a, b in zip(left_columns, one, other, strict=True):
            same = a == b and type(a) is type(b)
            if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
                same = True
            if not same:
                found.append(f"{name}: {a!r} / {b!r}")
        if len(found) > 5:
            break
    return found


def compare(spark, connection, name: str, sf_dir: str) -> tuple[int, list[str]]:
    from meterwise.plans import oracle, registry

    frame = registry.queries()[name](spark, sf_dir)
    spark_side = normal(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(oracle.oracle_sql()[name])
    sql_side = normal([d[0] for d in result.description], result.fetchall())
    return len(spark_side[1]), differences(spark_side, sql_side)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from meterwise.plans import oracle, registry
    from meterwise.session import build_session

    session = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:] or list(registry.queries())
    database = connect(folder)
    print("without SQL:", sorted(set(registry.queries()) - set(oracle.oracle_sql())))
    for query in names:
        begin = time.time()
        try:
            count, wrong = compare(session, database, query, folder)
            print(f"{'ok  ' if not wrong else 'DIFF'} {query:28s} {count:7d} rows {time.time() - begin:6.2f} s", *wrong[:6], sep="\n       " if wrong else " ", flush=True)
        except Exception as error:  # noqa: BLE001
            print("FAIL", query, str(error)[:700], flush=True)
