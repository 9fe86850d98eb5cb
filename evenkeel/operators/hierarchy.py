"""Large payment-level groups: payment -> contract -> case, and the one-level short form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.functions import aggregates as A
from evenkeel.functions.aggregates import Measure
from evenkeel.functions.naming import DEFAULT, Naming
from evenkeel.functions.scalar import any_of_row, month_period, safe_div, to_double
from evenkeel.operators.grouping import aggregate_by_key
from evenkeel.operators.policies import row_count

COLUMN_STATS = ("sum", "count", "mean", "max", "min", "std", "range")


def available(df: DataFrame, group: str) -> list[str]:
    return [c for c in fixed.LARGE_COLUMNS[group] if c in df.columns]


def lite_measures(group: str, columns: Sequence[str]) -> list[Measure]:
    return [row_count(group)] + [
        Measure(f"{group}__{c}__{op}", op, c) for c in columns for op in ("mean", "max", "min")
    ]


def aggregate_large_lite(df: DataFrame, group: str, naming: Naming = DEFAULT) -> DataFrame:
    """Row count and mean, max, min of the listed columns. One aggregation over all files:
    Spark's partial step does the merging."""
    cols = available(df, group)
    return aggregate_by_key(df.select(naming.key, *cols), naming.key, lite_measures(group, cols))


def _roles(columns: Sequence[str]) -> dict[str, dict[str, str]]:
    """Payment sides restricted to the columns that exist."""
    return {
        side: {role: c for role, c in names.items() if c in columns} for side, names in fixed.PAYMENT_SIDES.items()
    }


def contract_basic(group: str, naming: Naming = DEFAULT) -> list[Column]:
    inner = F.col(naming.inner_ordinal).try_cast("bigint")
    p = f"{group}__contract__"
    return [
        F.count(F.lit(1)).alias(f"{p}payment_count"),
        F.count(inner).alias(f"{p}num_group2_count"),
        F.max(inner).alias(f"{p}num_group2_max"),
        F.min(inner).alias(f"{p}num_group2_min"),
    ]


def contract_column_stats(group: str, columns: Sequence[str]) -> list[Column]:
    ops = {**A.PLAIN_OPS, "range": A.gap}
    return [
        ops[op](to_double(c)).alias(f"{group}__contract__{c}__{op}") for c in columns for op in COLUMN_STATS
    ]


def contract_overdue_flags(group: str, columns: Sequence[str], limits: Sequence[int] = fixed.DPD_LIMITS) -> list[Column]:
    """Any overdue, payments above each day limit, and flags for the positive limits."""
    p = f"{group}__contract__"
    sides = _roles(columns).values()
    dpd = [to_double(s["dpd"]) for s in sides if "dpd" in s]
    amounts = [to_double(s["overdue"]) for s in sides if "overdue" in s]

    def above(cols: Sequence[Column], limit: float) -> list[Column]:
        return [F.coalesce(c, F.lit(0.0)) > limit for c in cols]

    either = dpd + amounts
    out = [(A.any_flag(above(either, 0)) if either else F.lit(None).cast("int")).alias(f"{p}has_overdue")]
    if dpd:
        out += [A.threshold_count(dpd, n).alias(f"{p}dpd_gt{n}_payment_count") for n in limits]
        out += [A.any_flag(above(dpd, n)).alias(f"{p}has_dpd_gt{n}") for n in limits if n]
    if amounts:
        out.append(A.threshold_count(amounts, 0).alias(f"{p}overdue_amt_gt0_payment_count"))
    return out


def contract_active_closed(group: str, columns: Sequence[str]) -> list[Column]:
    """Payments with any value on a side, and bad payments per side."""
    p = f"{group}__contract__"
    out = []
    for side, names in _roles(columns).items():
        if not names:
            continue
        used = any_of_row([to_double(c).isNotNull() for c in names.values()])
        out += [F.sum(used.cast("int")).alias(f"{p}{side}_payment_count"), A.any_flag([used]).alias(f"{p}has_{side}_payment")]
        if "dpd" in names:
            out.append(A.threshold_count([to_double(names["dpd"])], 30).alias(f"{p}{side}_dpd_gt30_payment_count"))
        if "overdue" in names:
            out.append(
                A.threshold_count([to_double(names["overdue"])], 0).alias(f"{p}{side}_overdue_amt_gt0_payment_count")
            )
    return out


def contract_periods(group: str, columns: Sequence[str]) -> list[Column]:
    """First, last and spanned month per side, and the last month with more than 30 days past due."""
    p = f"{group}__contract__"
    out = []
    for side, names in _roles(columns).items():
        if not {"year", "month"} <= names.keys():
            continue
        period = month_period(to_double(names["year"]), to_double(names["month"]))
        out += [
            F.max(period).alias(f"{p}{side}_period_max"),
            F.min(period).alias(f"{p}{side}_period_min"),
            A.gap(period).alias(f"{p}{side}_period_span"),
        ]
        if "dpd" in names:
            bad = F.coalesce(to_double(names["dpd"]), F.lit(0.0)) > 30
            out.append(A.filtered_max(period, bad).alias(f"{p}{side}_dpd_gt30_period_max"))
    return out


def contract_table(df: DataFrame, group: str, naming: Naming = DEFAULT, parts: Sequence[str] | None = None) -> DataFrame:
    """One row per (case, contract). ``parts`` limits the column blocks."""
    cols = available(df, group)
    blocks = {
        "basic": lambda: contract_basic(group, naming),
        "stats": lambda: contract_column_stats(group, cols),
        "overdue": lambda: contract_overdue_flags(group, cols),
        "sides": lambda: contract_active_closed(group, cols),
        "periods": lambda: contract_periods(group, cols),
    }
    exprs = [e for name in (parts or blocks) for e in blocks[name]()]
    keyed = df.select(
        *[F.col(k).try_cast("bigint").alias(k) for k in (naming.key, *naming.ordinals)], *cols
    )
    return keyed.groupBy(naming.key, naming.outer_ordinal).agg(*exprs)


def _case_fold(name: str):
    """How a contract-level column is folded up to the case."""
    if name.endswith(("_period_max", "_period_span")):
        return F.max
    if name.endswith("_period_min"):
        return F.min
    return F.sum


def case_from_contracts(contracts: DataFrame, group: str) -> list[Column]:
    p = f"{group}__contract__"
    skip = {"payment_count", "num_group2_count", "num_group2_max", "num_group2_min", "has_overdue"}
    out = [F.count(F.lit(1)).alias(f"{group}__contract_count")]
    if f"{p}payment_count" in contracts.columns:
        payments = F.col(f"{p}payment_count")
        out += [
            F.sum(payments).alias(f"{group}__payment_count"),
            F.max(payments).alias(f"{group}__payment_count_contract_max"),
            F.avg(payments).alias(f"{group}__payment_count_contract_mean"),
        ]
    if f"{p}has_overdue" in contracts.columns:
        overdue = F.coalesce(F.sum(f"{p}has_overdue"), F.lit(0))
        out.append(overdue.alias(f"{group}__overdue_contract_count"))
    for c in contracts.columns:
        name = c.removeprefix(p)
        if c.startswith(p) and "__" not in name and name not in skip:
            out.append(_case_fold(name)(F.col(c)).alias(f"{group}__{name}"))
    return out


def case_column_stats(contracts: DataFrame, group: str) -> list[Column]:
    out = []
    for col in fixed.LARGE_COLUMNS[group]:
        src = {op: F.col(f"{group}__contract__{col}__{op}") for op in COLUMN_STATS}
        if f"{group}__contract__{col}__sum" not in contracts.columns:
            continue
        o = f"{group}__{col}__"
        total, count = F.sum(src["sum"]), F.sum(src["count"])
        out += [
            total.alias(f"{o}sum"),
            count.alias(f"{o}count"),
            safe_div(total, count).alias(f"{o}mean"),
            F.max(src["max"]).alias(f"{o}max"),
            F.min(src["min"]).alias(f"{o}min"),
            F.avg(src["mean"]).alias(f"{o}contract_mean_mean"),
            F.max(src["mean"]).alias(f"{o}contract_mean_max"),
            F.avg(src["std"]).alias(f"{o}contract_std_mean"),
            F.max(src["range"]).alias(f"{o}contract_range_max"),
        ]
    return out


def aggregate_two_stage(df: DataFrame, group: str, naming: Naming = DEFAULT) -> DataFrame:
    """Payment rows to one row per case through the contract level, over all files at once.

    A contract that spans files is one contract here. The two aggregations keep their own
    exchanges on purpose: partitioning the payments by case up front would put a hot case
    into one task, while partial aggregation on (case, contract) spreads it.
    """
    contracts = contract_table(df, group, naming)
    return contracts.groupBy(naming.key).agg(
        *case_from_contracts(contracts, group), *case_column_stats(contracts, group)
    )
