"""Compare a query with its SQL on DuckDB: names, row counts and values, whatever the order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((x is not None, f"{x:.4g}" if isinstance(x, float) else str(x)) for x in row)


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    clean = lambda x: round(float(x), 4) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=_key)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    """What differs, or an empty text."""
    df = query(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    out = con.execute(sql)
    want_names, want = [c[0] for c in out.description], out.fetchall()
    if sorted(map(str.lower, got_names)) != sorted(map(str.lower, want_names)):
        return f"columns {got_names} and {want_names}"
    a, b = rows(got_names, got), rows(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if any((p != q) and not (isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) <= 2e-4 * max(1, abs(p))) for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows, such as {bad[0]}" if bad else ""
