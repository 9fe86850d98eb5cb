"""Fitted preprocessing: an immutable state learned once and applied as plain expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from evenkeel.functions.naming import DEFAULT
from evenkeel.operators.columns import choose_columns
from evenkeel.operators.joins import map_values
from evenkeel.operators.ordering import exact_medians
from evenkeel.operators.profile import ColumnProfile, profile_columns
from evenkeel.operators.skew import BROADCAST_ROWS, lookup_join
from evenkeel.session import materialise

PAIR_BLOCK = 200


@dataclass(frozen=True)
class PreprocessState:
    feature_cols: list[str]
    category_maps: dict[str, list[str]]
    fill_values: dict[str, float]
    dropped_columns: dict[str, list[str]]
    missing_indicator_cols: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "PreprocessState":
        return PreprocessState(**json.loads(text))

    def summary(self) -> dict[str, int]:
        """Drop counts per reason, kept features and flags."""
        counts = {k: len(v) for k, v in self.dropped_columns.items()}
        return counts | {"kept": len(self.feature_cols), "missing_indicators": len(self.missing_indicator_cols)}


def missing_indicator(name: str, have: bool) -> Column:
    """1 where the source is null, or everywhere when it does not exist."""
    return F.col(f"`{name}`").isNull().cast("int") if have else F.lit(1)


def category_lists(df: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """Sorted categories; callers have already bounded their number."""
    out = {}
    for n in names:
        rows = df.select(F.col(f"`{n}`").cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
        out[n] = [r["v"] for r in rows.orderBy("v").collect()]
    return out


def fit_preprocessor(
    df: DataFrame,
    max_missing: float = 0.92,
    max_cat_unique: int = 200,
    min_unique: int = 2,
    target: str = DEFAULT.target,
    key: str = DEFAULT.key,
    keep: Sequence[str] = (DEFAULT.week,),
    missing_indicator_min_rate: float | None = None,
) -> PreprocessState:
    candidates = [c for c in df.columns if c not in (key, target)]
    profiles = profile_columns(df, candidates, enough=min_unique)
    frame = df.select(*[F.col(f"`{c}`") for c in candidates])
    chosen = choose_columns(
        frame, max_missing, max_cat_unique, min_unique, protected=keep, null_is_value=False, profiles=profiles
    )
    flags: dict[str, str] = {}
    if missing_indicator_min_rate is not None:
        for c in chosen.kept:
            rate = profiles[c].missing_rate
            if c not in keep and rate >= missing_indicator_min_rate and rate > 0:
                flags[c] = f"{c}__is_missing"
    text = [c for c in chosen.kept if profiles[c].is_text]
    numeric = [c for c in chosen.kept if isinstance(profiles[c].dtype, T.NumericType)]
    medians = exact_medians(df, {c: F.col(f"`{c}`") for c in numeric})
    fills = {c: float(m) if m is not None else 0.0 for c, m in medians.items()}
    return PreprocessState(
        feature_cols=[*chosen.kept, *flags.values()],
        category_maps=category_lists(df, text),
        fill_values=fills,
        dropped_columns=chosen.dropped,
        missing_indicator_cols=flags,
    )


def _position_in(categories: Sequence[str], c: Column) -> Column:
    """Index in a sorted list, -1 for null and unseen values."""
    return map_values(c.cast("string"), {v: i for i, v in enumerate(categories)}, -1).cast("int")


def apply_preprocessor(df: DataFrame, state: PreprocessState, keep: Sequence[str] = ()) -> DataFrame:
    """One projection: flags, aligned columns, category codes, median fill, float columns.

    ``keep`` columns come first and stay as they are.
    """
    have = set(df.columns)
    sources = {flag: src for src, flag in state.missing_indicator_cols.items()}
    out: list[Column] = [F.col(k) for k in keep]
    for c in state.feature_cols:
        if c in keep:
            continue
        if c in sources and c not in have:
            column = missing_indicator(sources[c], sources[c] in have)
        elif c not in have:
            column = F.lit(state.fill_values[c]).cast("float") if c in state.fill_values else F.lit(-1)
        elif c in state.category_maps:
            column = _position_in(state.category_maps[c], F.col(f"`{c}`"))
        elif isinstance(df.schema[c].dataType, T.BooleanType):
            column = F.col(f"`{c}`").cast("int")
        elif c in state.fill_values:
            column = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(state.fill_values[c])).cast("float")
        else:
            column = F.col(f"`{c}`")
        out.append(column.alias(c))
    return df.select(*out)


def category_codes(df: DataFrame, name: str, out: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Sorted position of each category, null as -1; any number of categories.

    The distinct values are spread over ranges. A value's code is its rank within its range plus what lies below; only the
    totals of the ranges are gathered.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(name).where(F.col(name).isNotNull()).distinct()
    ranged = materialise(values.repartitionByRange(n, name).withColumn("__range", F.spark_partition_id()), "categories")
    below = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    begins = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    begins = begins.select("__range", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__begin"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(name)) - 1
    codes = ranged.withColumn("__k", inside).join(F.broadcast(begins), "__range")
    codes = codes.select(name, (F.col("__begin") + F.col("__k")).cast("int").alias(out))
    return lookup_join(df, codes, name, max_rows=max_rows).withColumn(out, F.coalesce(F.col(out), F.lit(-1))).select(*df.columns, out)


def median_impute(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Nulls become the exact median, or 0 in an all-null column."""
    medians = exact_medians(df, {n: F.col(n) for n in names})
    return df.withColumns(
        {n: F.coalesce(F.col(n).cast("double"), F.lit(float(m) if m is not None else 0.0)) for n, m in medians.items()}
    )


def count_encode(
    df: DataFrame, names: Sequence[str], fit_on: DataFrame | None = None, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``<name>_cnt``: how often the value occurs in ``fit_on``; null -2, unseen -1."""
    reference = df if fit_on is None else fit_on
    out = df
    for n in names:
        counts = reference.where(F.col(n).isNotNull()).groupBy(n).agg(F.count(F.lit(1)).alias("__c"))
        out = lookup_join(out, counts, n, max_rows=max_rows)
        code = F.when(F.col(n).isNull(), -2).otherwise(F.coalesce(F.col("__c"), F.lit(-1))).cast("long")
        out = out.withColumn(f"{n}_cnt", code).drop("__c")
    return out.select(*df.columns, *[f"{n}_cnt" for n in names])


def null_groups(profiles: Mapping[str, ColumnProfile]) -> dict[int, list[str]]:
    """Columns by their number of nulls, in column order."""
    out: dict[int, list[str]] = {}
    for name, p in profiles.items():
        out.setdefault(p.nulls, []).append(name)
    return out


def pairwise_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson over the rows where both values exist; a bounded block of pairs per pass."""
    out = {}
    for start in range(0, len(pairs), PAIR_BLOCK):
        block = pairs[start : start + PAIR_BLOCK]
        row = df.agg(
            *[
                F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{i}")
                for i, (a, b) in enumerate(block)
            ]
        ).first()
        out |= {pair: row[f"c{i}"] for i, pair in enumerate(block)}
    return out


def correlation_prune(df: DataFrame, names: Sequence[str], threshold: float = 0.8) -> list[str]:
    """Within columns of equal null count, correlated ones form a group that keeps its member
    with the most distinct values (the first on ties)."""
    profiles = profile_columns(df, names)
    waiting = list(null_groups(profiles).values())
    kept = []
    while waiting:
        # One pass for the leaders of all groups against their rests.
        pairs = [(g[0], c) for g in waiting for c in g[1:]]
        corr = pairwise_correlations(df, pairs)
        later = []
        for lead, *rest in waiting:
            alike = [lead] + [c for c in rest if (corr[(lead, c)] or 0.0) >= threshold]
            kept.append(max(alike, key=lambda c: profiles[c].distinct))
            left = [c for c in rest if c not in alike]
            if left:
                later.append(left)
        waiting = later
    order = {c: i for i, c in enumerate(c for g in null_groups(profiles).values() for c in g)}
    return sorted(kept, key=order.__getitem__)


def standardize_features(df: DataFrame, names: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """(x - mean) / population deviation; tiny deviations count as 1, gaps and infinities as 0."""
    stats = df.agg(
        *[e for n in names for e in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))]
    ).first()
    out = {}
    for n in names:
        m, s = stats[f"m_{n}"], stats[f"s_{n}"]
        if m is None:
            out[n] = F.lit(0.0)
            continue
        z = (F.col(n).cast("double") - F.lit(m)) / F.lit(s if s is not None and s >= floor else 1.0)
        finite = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != F.lit(float("inf")))
        out[n] = F.when(finite, z).otherwise(F.lit(0.0))
    return df.withColumns(out)
