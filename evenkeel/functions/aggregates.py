"""Aggregate expressions with fixed null rules.

``Measure`` is a declarative request (output name, operation, source column); policies emit
lists of them and ``operators.grouping`` decides how to run them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """One output column of a grouped aggregation.

    mode: ``number`` lenient double, ``raw`` the column as it is, ``before`` days from the
    event to the decision (worked out after grouping, the decision being constant per key).
    """

    out: str
    op: str
    col: str | None = None
    mode: str = "number"
    fill: float | None = None
    only: tuple[str, object] | None = None


def mean(x: Column) -> Column:
    return F.avg(x)


def total(x: Column) -> Column:
    """Sum that is 0 when every value is null."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def spread(x: Column) -> Column:
    """Sample standard deviation; null for a single value."""
    return F.stddev_samp(x)


def gap(x: Column) -> Column:
    return F.max(x) - F.min(x)


def n_unique(x: Column) -> Column:
    """Distinct values, null counting as one."""
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def order_key(order: Sequence[str]) -> Column:
    """One ordering value; a single column stays plain so that hash aggregation applies."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_by(x: Column, order: Column) -> Column:
    return F.min_by(x, order)


def last_by(x: Column, order: Column) -> Column:
    return F.max_by(x, order)


def any_flag(conditions: Sequence[Column]) -> Column:
    """1 when any row meets any condition; conditions must not be null."""
    hit = conditions[0]
    for c in conditions[1:]:
        hit = hit | c
    return F.max(hit.cast("int"))


def threshold_count(columns: Sequence[Column], limit: float) -> Column:
    """Values above the limit over all columns; one row may count once per column."""
    hits = [(F.coalesce(c, F.lit(0.0)) > limit).cast("int") for c in columns]
    row = hits[0]
    for h in hits[1:]:
        row = row + h
    return F.sum(row)


def filtered_max(x: Column, condition: Column) -> Column:
    return F.max(F.when(condition, x))


PLAIN_OPS = {
    "mean": mean,
    "max": F.max,
    "min": F.min,
    "std": spread,
    "var": F.var_samp,
    "sum": total,
    "count": F.count,
    "gap": gap,
}
ORDERED_OPS = ("first", "last")
OPS = (*PLAIN_OPS, *ORDERED_OPS, "median", "nunique", "row_count")

# What to ask of the raw day number so that decision - day has the wanted statistic.
BEFORE_OPS = {"max": "min", "min": "max"}


def check_op(op: str) -> None:
    if op not in OPS:
        raise ValueError(f"{op!r} is no aggregate")
