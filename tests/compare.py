"""Holds a query's rows against its SQL oracle: same columns, same rows in any order."""

import math
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for entry in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{entry}"
        con.execute(f"CREATE VIEW {entry.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return round(float(value), 5) + 0.0
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2.1e-5)
    return a == b


def assert_same(df, con, sql: str) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(map(close, g, w))]
    assert not bad, bad[:3]
