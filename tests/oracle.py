"""Runs SQL over the Parquet tables of a folder and compares results without order."""

from __future__ import annotations

import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows(frame_rows) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in frame_rows)


def same(con, df, sql: str) -> None:
    columns = sorted(df.columns)
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows(tuple(r[i] for i in at) for r in relation.fetchall())
