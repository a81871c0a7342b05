"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, folder: str, plan, sql: str) -> str:
    """Empty if the plan and the SQL agree in columns and rows."""
    df = plan(spark, folder)
    rel = connect(folder).sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [f"{c}: {k} and {kinds[c]}" for c, k in df.dtypes if same.get(k, kinds[c]) != kinds[c]]
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}; types {odd}"
    return f"types {odd}" if odd else ""
