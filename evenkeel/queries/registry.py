"""Registry of queries and their check SQL, and small SQL text helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.queries.bindings import bound_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 4
# Averages of money often end exactly on a rounding tie, which engines break differently.
# Both sides move off the tie by the same hair before rounding.
TIE_SHIFT = "3.1e-7"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floating columns rounded for comparison; 0.0 is added so that -0.0 reads 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`").cast("double") + F.lit(float(TIE_SHIFT)), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def R(expr: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {TIE_SHIFT}, {digits}) + 0.0"


def with_(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items())


def bound(*groups: str, binding: str = "orders") -> dict[str, str]:
    """CTEs of bound groups under their own names."""
    return {g: bound_sql(g, binding) for g in groups}


SQL_OPS = {
    "mean": "avg({x})",
    "max": "max({x})",
    "min": "min({x})",
    "std": "stddev_samp({x})",
    "var": "var_samp({x})",
    "sum": "coalesce(sum({x}), 0)",
    "median": "median({x})",
    "gap": "max({x}) - min({x})",
    "first": "first({x} ORDER BY {order})",
    "last": "last({x} ORDER BY {order})",
}


def agg_sql(
    out: str,
    op: str,
    col: str,
    mode: str = "number",
    order: str = "num_group1",
    fill: bool = False,
    where: str = "",
    digits: int = DIGITS,
) -> str:
    """One aggregate as check SQL. Mode ``before`` takes the column ``__dec`` minus the day."""
    if op == "row_count":
        return f'CAST(count(*) AS BIGINT) AS "{out}"'
    if op == "nunique":
        return (
            f'CAST(count(DISTINCT "{col}") + max(CASE WHEN "{col}" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "{out}"'
        )
    if op == "count":
        return f'CAST(count("{col}") AS BIGINT) AS "{out}"'
    x = f'"{col}"' if mode == "raw" else f'TRY_CAST("{col}" AS DOUBLE)'
    if mode == "before":
        x = f'(__dec - CAST("{col}" AS DOUBLE))'
    if fill:
        x = f"coalesce({x}, 0)"
    if where:
        x = f"CASE WHEN {where} THEN {x} END"
    text = SQL_OPS[op].format(x=x, order=order)
    return f'{text} AS "{out}"' if mode == "raw" else f'{R(text, digits)} AS "{out}"'


def group_sql(group: str, cells: Sequence[str], dated: bool = False, key: str = "case_id", binding: str = "orders") -> str:
    """Check SQL: a bound group aggregated per case, with the decision day as __dec if dated."""
    cells = ", ".join(cells)
    if dated:
        ctes = with_(**bound(group, "base", binding=binding))
        return (
            f"{ctes} SELECT c.{key}, {cells} FROM (SELECT g.*, b.date_decision AS __dec "
            f"FROM {group} g LEFT JOIN base b USING ({key})) c GROUP BY c.{key}"
        )
    return f"{with_(**bound(group, binding=binding))} SELECT {key}, {cells} FROM {group} GROUP BY {key}"
