"""Holds a query's rows against its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def rows(df) -> list[tuple]:
    """Rows with columns by name, values comparable across engines, sorted."""
    columns = sorted(df.columns)
    show = lambda v: "" if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(show(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)


def check(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
