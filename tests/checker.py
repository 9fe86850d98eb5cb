"""Runs registered queries and their check SQL side by side."""

from __future__ import annotations

import math

import duckdb

from evenkeel.queries.bindings import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want, want_cols = rows_of(cols, res.fetchall())
    if got_cols != want_cols:
        return f"columns: only spark {sorted(set(got_cols) - set(want_cols))[:8]}, only sql {sorted(set(want_cols) - set(got_cols))[:8]}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b][:5]
        return f"{len(bad)} rows differ, e.g. {cells}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck = {d[0]: str(d[1]) for d in res.description}
    fit = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
           "date": "DATE", "tinyint": "TINYINT", "float": "FLOAT"}
    odd = {c: (t, duck[c]) for c, t in types.items() if fit.get(t, t) != duck[c]}
    return None if not odd else f"TYPES {dict(list(odd.items())[:6])}"
