"""Time-ordered validation: windows, holdout, expanding-window runs and ablations."""

from __future__ import annotations

import inspect
import statistics
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.functions.naming import DEFAULT, Naming
from evenkeel.operators.columns import drop_by_prefix_or_agg
from evenkeel.operators.encode import apply_preprocessor, fit_preprocessor
from evenkeel.operators.metrics import auc, fold_summary, gini, stability_metric
from evenkeel.operators.models import Fitted
from evenkeel.session import materialise

#: A fit takes rows and features and, if it wants to stop early, the name of a column that flags the rows to stop on.
Fit = Callable[..., Fitted]
VALID_FLAG = "__valid"
FOLD_METRICS = ("auc", "gini", "stability", "mean_gini")


def fold_windows(max_week: int, valid_weeks: int, folds: int, gap_weeks: int = 0) -> list[tuple[int, int]]:
    """Validation windows counted back from the last week, oldest first; none may start below 0."""
    stride = valid_weeks + gap_weeks
    starts = [max_week - valid_weeks + 1 - i * stride for i in range(folds)]
    return [(s, s + valid_weeks - 1) for s in reversed(starts) if s >= 0]


def max_week(df: DataFrame, week: str = DEFAULT.week) -> int:
    return int(df.agg(F.max(week)).first()[0])


def holdout_last_weeks(df: DataFrame, weeks: int = 20, week: str = DEFAULT.week) -> tuple[DataFrame, DataFrame, int]:
    """(train, valid, first validation week)."""
    start = max_week(df, week) - weeks + 1
    return df.where(F.col(week) < start), df.where(F.col(week) >= start), start


def _score_fold(valid: DataFrame, naming: Naming) -> DataFrame:
    total = auc(valid, "score", naming.target).select("n", "auc", gini(F.col("auc")).alias("gini"))
    stable = stability_metric(valid, "score", naming.target, naming.week)
    # One row each.
    return total.withColumn("__one", F.lit(1)).join(stable.withColumn("__one", F.lit(1)), "__one").drop("__one")


@dataclass(frozen=True)
class Fold:
    """One window: the rows before it and in it, preprocessed by what the rows before it show."""

    number: int
    start: int
    end: int
    train: DataFrame
    valid: DataFrame
    features: tuple[str, ...]

    def fitted(self, fit: Fit) -> Fitted:
        """A fit that takes a third argument gets the window too, its rows flagged in that column, to stop early."""
        if len(inspect.signature(fit).parameters) < 3:
            return fit(self.train, self.features)
        flagged = self.train.withColumn(VALID_FLAG, F.lit(False)).unionByName(self.valid.withColumn(VALID_FLAG, F.lit(True)))
        return fit(flagged, self.features, VALID_FLAG)


def prepared_folds(
    df: DataFrame, valid_weeks: int = 20, folds: int = 5, gap_weeks: int = 0, naming: Naming = DEFAULT, **prep
) -> Iterator[Fold]:
    """The windows, oldest first. Each is preprocessed once, however many models are fitted to it.

    Pass a table read back from files: every fold reads its weeks from it more than once.
    """
    windows = fold_windows(max_week(df, naming.week), valid_weeks, folds, gap_weeks)
    if not windows:
        raise ValueError("there are too few weeks for a window")
    ids = (naming.key, naming.target, naming.week)
    for number, (start, end) in enumerate(windows, start=1):
        train = df.where(F.col(naming.week) < start)
        state = fit_preprocessor(train, target=naming.target, key=naming.key, keep=(naming.week,), **prep)
        features = tuple(c for c in state.feature_cols if c not in ids)
        valid = df.where(F.col(naming.week).between(start, end))
        yield Fold(number, start, end, apply_preprocessor(train, state, ids), apply_preprocessor(valid, state, ids), features)


def expanding_window_cv(
    df: DataFrame,
    fit: Fit,
    valid_weeks: int = 20,
    folds: int = 5,
    gap_weeks: int = 0,
    naming: Naming = DEFAULT,
    **prep,
) -> DataFrame:
    """Per fold: preprocessing and model see only weeks before the window, which is then scored."""
    ids = (naming.key, naming.target, naming.week)
    result = None
    for fold in prepared_folds(df, valid_weeks, folds, gap_weeks, naming, **prep):
        model = fold.fitted(fit)
        # Written once: the metrics read the predictions several times.
        scored = materialise(model.score(fold.valid).select(*ids, "score"), "fold")
        part = _score_fold(scored, naming).select(
            F.lit(fold.number).alias("fold"),
            F.lit(fold.start).alias("valid_start_week"),
            F.lit(fold.end).alias("valid_end_week"),
            F.col("n").alias("valid_rows"),
            F.lit(len(fold.features)).alias("n_features"),
            F.lit(model.best_iteration).alias("best_iteration"),
            "auc", "gini", "stability", "mean_gini", "slope", "falling_rate", "residual_std", "n_weeks",
        )
        result = part if result is None else result.unionByName(part)
    return result


def oof_predictions(
    df: DataFrame, fits: Mapping[str, Fit], valid_weeks: int = 20, folds: int = 5, gap_weeks: int = 0, naming: Naming = DEFAULT, **prep
) -> DataFrame:
    """fold, key, week, target and one ``<model>_pred`` column per model.

    All models of a fold score the same rows one after the other, so nothing is joined and nothing is judged here.
    """
    frames = []
    for fold in prepared_folds(df, valid_weeks, folds, gap_weeks, naming, **prep):
        scored = fold.valid
        for name, fit in fits.items():
            scored = fold.fitted(fit).score(scored, f"{name}_pred")
        kept = scored.select(naming.key, naming.week, naming.target, *[f"{name}_pred" for name in fits])
        frames.append(materialise(kept.select(F.lit(fold.number).alias("fold"), "*"), "oof"))
    return union_folds(frames)


def fit_with_holdout(
    df: DataFrame, fit: Fit, refit: Callable[[DataFrame, Sequence[str], int], Fitted], weeks: int = 20, naming: Naming = DEFAULT, **prep
) -> tuple[Fitted, DataFrame, int]:
    """(model of all rows, holdout metrics, best iteration): the last weeks tell when to stop, then all rows are fitted so far.

    The preprocessing of the refit is learned from all rows as well.
    """
    fold = next(prepared_folds(df, weeks, 1, 0, naming, **prep))
    first = fold.fitted(fit)
    ids = (naming.key, naming.target, naming.week)
    metrics = _score_fold(materialise(first.score(fold.valid).select(*ids, "score"), "holdout"), naming)
    state = fit_preprocessor(df, target=naming.target, key=naming.key, keep=(naming.week,), **prep)
    features = [c for c in state.feature_cols if c not in ids]
    return refit(apply_preprocessor(df, state, ids), features, first.best_iteration), metrics, first.best_iteration


def union_folds(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def ablation_groups(suite: str) -> dict[str, tuple[str, ...]]:
    if suite not in ("table", "agg"):
        raise ValueError(f"there is no suite {suite!r}")
    return fixed.ABLATION_TABLES if suite == "table" else fixed.ABLATION_AGGS


def run_ablations(
    df: DataFrame, suite: str, fit: Fit, only: Sequence[str] = (), naming: Naming = DEFAULT, **cv
) -> DataFrame:
    """One validation summary per named group of dropped columns."""
    groups = ablation_groups(suite)
    names = list(only) or list(groups)
    unknown = [n for n in names if n not in groups]
    if unknown:
        raise ValueError(f"{unknown[0]!r} is no ablation of this suite; it has {', '.join(sorted(groups))}")
    out = None
    for name in names:
        kind = "prefixes" if suite == "table" else "aggs"
        variant, dropped = drop_by_prefix_or_agg(df, **{kind: groups[name]})
        folds = expanding_window_cv(variant, fit, naming=naming, **cv)
        summary = fold_summary(folds, FOLD_METRICS).select(
            F.lit(name).alias("ablation"),
            F.lit(sum(len(v) for v in dropped.values())).alias("dropped"),
            "*",
        )
        out = summary if out is None else out.unionByName(summary)
    return out


def assign_balanced(counts: Mapping[int, Sequence[int]], folds: int) -> dict[int, int]:
    """Groups to folds so that every class is spread evenly: the most lopsided groups first,
    each to the fold that leaves the class shares closest together."""
    classes = len(next(iter(counts.values())))
    totals = [sum(c[k] for c in counts.values()) or 1 for k in range(classes)]
    load = [[0] * classes for _ in range(folds)]
    out = {}

    def unevenness(fold: int, add: Sequence[int]) -> tuple[float, int]:
        shares = [
            statistics.pstdev([(load[f][k] + (add[k] if f == fold else 0)) / totals[k] for f in range(folds)])
            for k in range(classes)
        ]
        return sum(shares) / classes, sum(load[fold])

    for g in sorted(counts, key=lambda g: (-statistics.pstdev(counts[g]), g)):
        best = min(range(folds), key=lambda f: unevenness(f, counts[g]))
        out[g] = best
        load[best] = [a + b for a, b in zip(load[best], counts[g])]
    return out


def week_grouped_stratified_folds(
    df: DataFrame, folds: int = 10, week: str = DEFAULT.week, target: str = DEFAULT.target
) -> DataFrame:
    """Adds ``fold``: weeks stay whole and classes are balanced. Only one row per week reaches
    the driver, and the week -> fold table goes back as a broadcast."""
    hits = F.sum(F.col(target).cast("long"))
    rows = df.groupBy(week).agg((F.count(F.lit(1)) - hits).alias("neg"), hits.alias("pos")).collect()
    chosen = assign_balanced({r[week]: (r["neg"], r["pos"]) for r in rows}, folds)
    table = df.sparkSession.createDataFrame(
        [(w, f) for w, f in chosen.items()], f"`{week}` {df.schema[week].dataType.simpleString()}, fold int"
    )
    return df.join(F.broadcast(table), week, "left").select(*df.columns, "fold")
