"""Compare a registered query with its SQL twin: columns, row count, values in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        if math.isnan(number):
            return "nan"
        return repr(number + 0.0)
    return str(value)


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, function, sql: str, folder: str, may_be_empty: bool = False) -> str | None:
    df = function(spark, folder)
    got_cols, got = canonical(df.columns, df.collect())
    result = con.execute(sql)
    want_cols, want = canonical([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: {[x for x in got if x not in want][:2]} / {[x for x in want if x not in got][:2]}"
    if not want and not may_be_empty:
        return "empty result"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None
