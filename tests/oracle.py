"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from lakecheck.plans import ORACLES, QUERIES
from lakecheck.plans.inputs import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    """Values that print alike on both sides; nothing is rounded beyond the last bits of a double."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    if isinstance(value, Decimal):
        return format(value, "f")
    return str(value)


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    mine = sorted_rows(df.columns, df.collect())
    if name not in ORACLES:
        return None
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    theirs = sorted_rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}; e.g. {mine[:2]} {theirs[:2]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"columns {sorted(names)}\n  {a}\n  {b}"
    return None


SPARK_NAMES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


def type_difference(spark, con, name: str, sf_dir: str) -> dict:
    """Columns whose types differ between both sides."""
    mine = dict(QUERIES[name](spark, sf_dir).dtypes)
    theirs = {r[0]: SPARK_NAMES.get(r[1], r[1].lower()) for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    return {c: (mine.get(c), theirs.get(c)) for c in mine.keys() | theirs.keys() if mine.get(c) != theirs.get(c)}
