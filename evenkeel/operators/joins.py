"""Joins of the feature build and of scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.skew import BROADCAST_ROWS, lookup_join, skewed_join


def left_join_on_key(left: DataFrame, right: DataFrame, key: str, suffix: str = "_right") -> DataFrame:
    """Left equi-join; right columns whose name is taken get the suffix first."""
    taken = set(left.columns)
    names = {c: f"{c}{suffix}" if c in taken and c != key else c for c in right.columns}
    clash = [n for c, n in names.items() if c != n and n in taken]
    if clash:
        raise ValueError(f"columns {clash} exist already; choose another suffix")
    return left.join(right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), key, "left")


def wide_left_join(base: DataFrame, parts: Sequence[DataFrame | None], key: str, numbered_from: int | None = None) -> DataFrame:
    """Chain of left joins on one key. Every part has one row per key and is already
    partitioned by it, so the chain costs one exchange per input and none per join.
    A part of None was pruned; it keeps its number. Clashing names get the part's number from the
    given part on, before it (or without one) the plain suffix."""
    out = base
    for i, part in enumerate(parts):
        if part is not None:
            numbered = numbered_from is not None and i >= numbered_from
            out = left_join_on_key(out, part, key, f"_{i}" if numbered else "_right")
    return out


def semi_filter(df: DataFrame, ids: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is in ``ids``, whatever their number; the id list is broadcast only when it is measured small."""
    return skewed_join(df, ids.select(key), key, "left_semi", max_rows)


def attach_decision_date(events: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Every event row with its case's decision date."""
    return lookup_join(events, decisions, key)


def fill_with_mean(df: DataFrame, names: Sequence[str], means: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(means[n]).cast("double")) for n in names})


def column_means(df: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(n).alias(n) for n in names]).first()
    return {n: row[n] for n in names}


def align_to_ids(ids: DataFrame, scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    """One row per wanted id; ids without a score get the mean score."""
    means = column_means(scores, [score])
    joined = ids.select(key).join(scores.select(key, score), key, "left")
    return fill_with_mean(joined, [score], means)


def join_branch_scores(first: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Score columns of several branches side by side; gaps get the branch mean."""
    out = first
    for branch in others:
        names = [c for c in branch.columns if c != key]
        out = fill_with_mean(out.join(branch, key, "left"), names, column_means(branch, names))
    return out


def merge_reports(left: DataFrame, right: DataFrame, columns: Sequence[str], on: str = "feature") -> DataFrame:
    """Report look-up by feature; only columns that exist are taken."""
    keep = [c for c in columns if c in right.columns and c != on]
    return left.join(right.select(on, *keep), on, "left")


def assign_fold_ranges(
    df: DataFrame, windows: Sequence[tuple[int, int]], week: str = "WEEK_NUM"
) -> DataFrame:
    """Each row once per fold it belongs to, as ``train`` (before the window) or ``valid``.

    The handful of windows sits in the plan as literals, so no join is needed.
    """
    w = F.col(week)
    cells = [
        F.struct(
            F.lit(i).alias("fold"),
            F.when(w < start, F.lit("train")).when(w.between(start, end), F.lit("valid")).alias("role"),
        )
        for i, (start, end) in enumerate(windows, start=1)
    ]
    used = F.filter(F.array(*cells), lambda s: s["role"].isNotNull())
    return df.select("*", F.explode(used).alias("__f")).select(*df.columns, "__f.fold", "__f.role")


def map_values(c: Column, mapping: Mapping[object, object], default: object) -> Column:
    """Small dictionary look-up held in the plan."""
    if not mapping:
        return F.lit(default)
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def concat_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Columns side by side: always computed on the same rows, never joined by position."""
    return df.withColumns(dict(new))


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows below each other after bringing shared columns to one type, wider type first."""
    targets: dict[str, str] = {}
    ranks = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "string"]
    for frame in frames:
        for name, dtype in frame.dtypes:
            known = targets.get(name, "void")
            if known == "void" or (dtype in ranks and known in ranks and ranks.index(dtype) > ranks.index(known)):
                targets[name] = dtype
    cast = [
        f.select(*[F.col(c).try_cast(targets[c]).alias(c) if t != targets[c] else F.col(c) for c, t in f.dtypes])
        for f in frames
    ]
    out = cast[0]
    for frame in cast[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, key: str, order: Sequence[str], drop_order: bool = False) -> DataFrame:
    """The row with the greatest order per key, by partial aggregation rather than a window."""
    picked = df.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("__row")
    )
    keep = [c for c in df.columns if not (drop_order and c in order)]
    return picked.select(*[F.col(key) if c == key else F.col(f"__row.`{c}`") for c in keep])


def distinct_by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key; which one is fixed by the row's content, so reruns agree."""
    return keep_last(df, key, [c for c in df.columns if c != key])
