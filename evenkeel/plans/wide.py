"""Assembly of the wide feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.functions.naming import DEFAULT, Naming
from evenkeel.functions.scalar import (
    days_after,
    decision_month,
    decision_weekday,
    hash_string_columns,
    normalize_dates,
)
from evenkeel.operators.derived import derive, source_columns
from evenkeel.operators.grouping import aggregate_by_key
from evenkeel.operators.hierarchy import aggregate_large_lite, aggregate_two_stage
from evenkeel.operators.joins import semi_filter, wide_left_join
from evenkeel.operators.policies import by_suffix_policy, choose_policy, prefix_large_policy
from evenkeel.operators.skew import HOT_ROWS
from evenkeel.plans.presets import parse_feature_set, preset, uses_custom
from evenkeel.sources.files import FeatureCache
from evenkeel.sources.tables import TableSource, load_base, load_depth0


def sample_head(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n smallest keys; planned as a top-n, not as a full sort."""
    return df.orderBy(key).limit(n)


def row_order(df: DataFrame, naming: Naming, tie_break: Sequence[str] = ()) -> tuple[str, ...]:
    """Columns that say which row of a case is first and last."""
    return tuple(c for c in (*naming.ordinals, *tie_break) if c in df.columns)


def aggregate_group(
    source: TableSource,
    group: str,
    feature_set: str = "none",
    ids: DataFrame | None = None,
    decisions: DataFrame | None = None,
    tie_break: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
    wanted: set[str] | None = None,
) -> DataFrame | None:
    """One row per case from one table group, with the policy the feature set selects.

    With ``wanted`` only measures of those names are run, and None is returned for no match.
    """
    naming = source.naming
    df = normalize_dates(source.table(group), naming)
    if ids is not None:
        df = semi_filter(df, ids, naming.key)
    components = parse_feature_set(feature_set)
    custom = uses_custom(components, group)
    measures = choose_policy(group, df.schema, components, custom, naming, dated=decisions is not None)
    if wanted is not None:
        measures = [m for m in measures if m.out in wanted]
        if not measures:
            return None
    return aggregate_by_key(df, naming.key, measures, row_order(df, naming, tie_break), decisions, hot_rows)


def aggregate_large(
    source: TableSource, group: str, feature_set: str = "none", ids: DataFrame | None = None, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Large groups: two-stage, prefix-named, by-suffix or short form."""
    naming = source.naming
    components = parse_feature_set(feature_set)
    df = source.table(group)
    if ids is not None:
        df = semi_filter(df, ids, naming.key)
    payments = group == fixed.PAYMENTS
    if payments and "sota_lgb_644" in components:
        df = normalize_dates(df, naming)
        return aggregate_by_key(df, naming.key, prefix_large_policy(df.schema, naming), hot_rows=hot_rows)
    if payments and "sota_cat_661" in components:
        df = normalize_dates(df, naming)
        return aggregate_by_key(df, naming.key, by_suffix_policy(group, df.schema, naming), row_order(df, naming), hot_rows=hot_rows)
    if payments and "a2_twostage" in components:
        return aggregate_two_stage(df, group, naming)
    return aggregate_large_lite(df, group, naming)


def subtract_decision_date(df: DataFrame, naming: Naming = DEFAULT, skip: Sequence[str] = ("std_",)) -> DataFrame:
    """Day-number columns become days after the decision. Spreads are left alone: a standard
    deviation minus a date means nothing."""
    if naming.decision not in df.columns:
        return df
    out = {
        c: days_after(c, naming.decision)
        for c in df.columns
        if c.endswith(naming.date_suffix)
        and c != naming.decision
        and "count" not in c
        and not c.startswith(tuple(skip))
    }
    return df.withColumns(out) if out else df


def calendar_columns(columns: Sequence[str], naming: Naming = DEFAULT) -> list[str]:
    """Columns named after a month or year whose suffix gives them no other meaning."""
    return [
        c
        for c in columns
        if c not in naming.protected and c[-1:] not in ("P", "A", "L", "M") and ("month_" in c or "year_" in c)
    ]


def date_feature_postprocess(df: DataFrame, naming: Naming = DEFAULT, drop_calendar: bool = True) -> DataFrame:
    out = subtract_decision_date(df, naming)
    drop = [c for c in (naming.decision, naming.month) if c in out.columns]
    if drop_calendar:
        drop += calendar_columns(out.columns, naming)
    return out.drop(*drop)


def decision_dates(base: DataFrame, naming: Naming = DEFAULT) -> DataFrame:
    return base.select(naming.key, F.col(naming.decision).try_cast("double").alias("__decision_date"))


def add_decision_parts(base: DataFrame, naming: Naming = DEFAULT) -> DataFrame:
    day = F.col(naming.decision)
    return base.withColumns({"decision_month": decision_month(day), "decision_weekday": decision_weekday(day)})


def build_features(
    source: TableSource,
    preset_name: str,
    feature_set: str = "none",
    output_columns: Sequence[str] | None = None,
    sample_rows: int = 0,
    cache: FeatureCache | None = None,
    split: str = "train",
    tie_break: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The wide table as one lazy plan: base, depth-0 rows, grouped tables, derived features.

    With ``cache`` the result is written once and read back (never for samples).
    """
    tables = preset(preset_name)
    components = parse_feature_set(feature_set)

    def build() -> DataFrame:
        return _assemble(source, tables, components, feature_set, output_columns, sample_rows, tie_break, hot_rows)

    if cache is None or sample_rows:
        return build()
    base = source.table("base")
    path = cache.path(split, preset_name, feature_set, output_columns, source.fingerprint())
    return cache.get(base.sparkSession, path, build)


def _assemble(source, tables, components, feature_set, output_columns, sample_rows, tie_break, hot_rows) -> DataFrame:
    naming = source.naming
    prefixed, by_suffix = "sota_lgb_644" in components, "sota_cat_661" in components
    base = load_base(source)
    if sample_rows:
        base = sample_head(base, sample_rows, naming.key)
    if (prefixed or by_suffix) and naming.decision in base.columns:
        base = add_decision_parts(base, naming)
    # A full build needs no id filter: the left joins drop foreign cases after grouping.
    ids = base.select(naming.key) if sample_rows else None
    decisions = decision_dates(base, naming)
    # The prefixed build numbers clashing names of every table, the by-suffix build those of grouped tables.
    numbered_from = 0 if prefixed else len(tables.depth0) if by_suffix else None
    # Row-wise counters read every column and prefixed names do not tell their table, so
    # those builds cannot be pruned early.
    wanted = None
    if output_columns is not None and not prefixed and "missing" not in components:
        wanted = source_columns(output_columns, feature_set) | set(naming.protected)
        if by_suffix:
            wanted |= {naming.decision, naming.month}
    small: list[DataFrame | None] = []
    for i, g in enumerate(tables.depth0):
        part = load_depth0(source, g, ids)
        suffix = f"_{i}" if numbered_from == 0 else "_right"
        used = wanted is None or any({c, f"{c}{suffix}"} & wanted for c in part.columns if c != naming.key)
        small.append(part if used else None)
    for g in tables.grouped:
        dated = decisions if uses_custom(components, g) else None
        small.append(aggregate_group(source, g, feature_set, ids, dated, tie_break, hot_rows, wanted))
    wide = wide_left_join(base, small, naming.key, numbered_from)
    if wanted is not None:
        wide = wide.select(*[F.col(f"`{c}`") for c in wide.columns if c in wanted])
    if by_suffix:
        wide = hash_string_columns(wide)
    large = [
        aggregate_large(source, g, feature_set, ids, hot_rows)
        for g in tables.large
        if wanted is None or any(c.startswith(f"{g}__") for c in wanted)
    ]
    wide = wide_left_join(wide, large, naming.key)
    if prefixed or by_suffix:
        wide = date_feature_postprocess(wide, naming, drop_calendar=prefixed)
    wide = derive(wide, feature_set, naming)
    if output_columns is not None:
        wanted = {*output_columns, naming.key, naming.target}
        wide = wide.select(*[c for c in wide.columns if c in wanted])
    return wide
