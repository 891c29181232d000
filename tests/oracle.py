"""Compare a Spark result with a DuckDB query over the same tables."""

import decimal
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.10g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def assert_same(df, con, sql):
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
