"""Spark rows held against DuckDB rows on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def in_order(columns: list[str], rows) -> list[tuple]:
    by_name = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in by_name) for r in rows), key=repr)


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        for p in sorted(Path(sf_dir).glob("*.parquet")):
            files = f"{p}/*.parquet" if p.is_dir() else str(p)
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
        out = db.execute(sql)
        columns = [c[0] for c in out.description]
        return sorted(columns), in_order(columns, out.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), in_order(df.columns, df.collect())
