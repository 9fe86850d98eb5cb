"""Blending of model scores, the weight search, and the optional time-based score shift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.functions.naming import DEFAULT, Naming
from evenkeel.functions.scalar import clip01, day_number, week_index
from evenkeel.operators.metrics import auc_of_buckets, gini, stability_of_weeks
from evenkeel.operators.ordering import find_cuts
from evenkeel.session import materialise
from pyspark.sql import types as T


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def weighted_blend(weights: Mapping[str, float]) -> Column:
    """Weighted mean of score columns, scaled by the weights in use."""
    return _sum([F.col(c) * F.lit(float(w)) for c, w in weights.items()]) / F.lit(float(sum(weights.values())))


def mean_vote(columns: Sequence[str]) -> Column:
    return _sum([F.col(c) for c in columns]) / F.lit(float(len(columns)))


def weight_grid(step: float = 0.05, max_third: float = 0.30) -> list[tuple[float, float, float]]:
    """All triples of multiples of the step that add up to 1, the third within its limit.

    Counted in whole steps, so no rounding decides which triples belong.
    """
    n = round(1 / step)
    most = int(max_third * n + 1e-9)
    triples = ((a, n - a - c, c) for a in range(n + 1) for c in range(min(most, n - a), -1, -1))
    return [tuple(round(k / n, 10) for k in t) for t in triples]


def expand_weights(df: DataFrame, models: Sequence[str], grid: Sequence[tuple[float, ...]]) -> DataFrame:
    """Each row once per weight row. The grid is a fixed parameter list, held as one literal."""
    names = [f"{m}_weight" for m in models]
    cells = ",".join("named_struct(" + ",".join(f"'{n}',{w!r}D" for n, w in zip(names, row)) + ")" for row in grid)
    spread = df.select("*", F.explode(F.expr(f"array({cells})")).alias("__w"))
    return spread.select(*df.columns, *[f"__w.{n}" for n in names])


#: Collapsed rows in a range of scores, and weight rows that are evaluated in one job.
RANGE_ROWS, GRID_BLOCK = 65_536, 32
_NO_WEEK = np.iinfo(np.int64).min
_RANGE = "slot int, bucket int, week binary, score binary, pos binary, neg binary"
_PAIRS = "slot int, bucket int, week bigint, overall boolean, pos bigint, neg bigint, won double"


def _pairs_won(group: np.ndarray, score: np.ndarray, pos: np.ndarray, neg: np.ndarray):
    """For each group value: its positives, negatives, and pairs in which a positive has the higher score, ties counting half."""
    order = np.lexsort((score, group))
    group, score, pos, neg = group[order], score[order], pos[order], neg[order]
    heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (score[1:] != score[:-1])))
    group, pos, neg = group[heads], np.add.reduceat(pos, heads), np.add.reduceat(neg, heads)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    before = np.cumsum(neg) - neg
    before -= np.repeat(before[first], np.diff(np.append(first, len(group))))
    twice = np.add.reduceat(pos * (2 * before + neg), first)
    return group[first], np.add.reduceat(pos, first), np.add.reduceat(neg, first), twice / 2


def _grid_pairs(collapsed: DataFrame, preds: Sequence[str], week: str, grid: Sequence[tuple[int, tuple[float, ...]]], points: Sequence[float]) -> DataFrame:
    """Pairs won inside each range of scores, by weight row: in all, and within each week.

    A task works out a batch's scores for all weight rows as arrays, and hands them on packed by range. A range is
    merged and sorted in one task; it holds a share of the rows that is set by the number of cut points.
    """
    cuts = np.array(points)

    def spread(batches):
        for b in batches:
            weeks, pos, neg = (b.column(k).to_numpy() for k in range(3))
            columns = [b.column(3 + k).to_numpy() for k in range(len(preds))]
            rows = []
            for slot, weights in grid:
                # Added up in the order of the models, as an expression would.
                score = reduce(lambda x, y: x + y, [w * c for w, c in zip(weights, columns)])
                bucket = np.where(np.isnan(score), -1, np.searchsorted(cuts, score, "right"))
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(len(cuts) + 2))
                for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                    if j > i:
                        own = order[i:j]
                        rows.append((slot, k, *(x[own].tobytes() for x in (weeks, score, pos, neg))))
            if rows:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["slot", "bucket", "week", "score", "pos", "neg"])

    def count(key, table):
        weeks, score, pos, neg = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("week", "<i8"), ("score", "<f8"), ("pos", "<i8"), ("neg", "<i8"))
        )
        names, p, n, won = _pairs_won(weeks, score, pos, neg)
        _, p_all, n_all, won_all = _pairs_won(np.zeros(len(score), np.int64), score, pos, neg)
        size = len(names) + 1
        names = pa.array(np.append(names, 0), mask=np.append(names == _NO_WEEK, True))
        return pa.table({
            "slot": pa.array([key[0].as_py()] * size, pa.int32()), "bucket": pa.array([key[1].as_py()] * size, pa.int32()), "week": names,
            "overall": pa.array([False] * (size - 1) + [True]), "pos": np.append(p, p_all), "neg": np.append(n, n_all), "won": np.append(won, won_all),
        })

    return collapsed.mapInArrow(spread, _RANGE).groupBy("slot", "bucket").applyInArrow(count, _PAIRS)


def blend_weight_search(
    oof: DataFrame,
    models: Mapping[str, str],
    step: float = 0.05,
    max_third: float = 0.30,
    target: str = "target",
    week: str = "WEEK_NUM",
) -> DataFrame:
    """Score every weight row by gini and stability, best first.

    Rows collapse to distinct (week, predictions) with class counts before any weight is applied. Weight rows are evaluated
    in blocks, so what one job shuffles is bounded by a block; its result, a row per weight row, range and week, is
    written. Cut points of the ranges come from the plain mean, as they only balance the work.
    """
    names, preds = [f"{m}_weight" for m in models], list(models.values())
    grid = list(enumerate(weight_grid(step, max_third)))
    hits = F.sum(F.col(target).cast("long"))
    rows = oof.where(F.col(target).isNotNull()).dropna(subset=preds).groupBy(
        F.coalesce(F.col(week).cast("long"), F.lit(_NO_WEEK)).alias("week"), *[F.col(p).cast("double").alias(p) for p in preds]
    )
    rows = rows.agg(hits.alias("pos"), (F.count(F.lit(1)) - hits).alias("neg")).select("week", "pos", "neg", *preds)
    rows = materialise(rows, "collapsed")
    ranges = -(-rows.count() // RANGE_ROWS)
    points = find_cuts(rows, {"s": mean_vote(preds)}, ranges)["s"].points if ranges > 1 else ()
    pairs = None
    for k in range(0, len(grid), GRID_BLOCK):
        block = materialise(_grid_pairs(rows, preds, week, grid[k : k + GRID_BLOCK], points), "pairs")
        pairs = block if pairs is None else pairs.unionByName(block)
    total = auc_of_buckets(pairs.where("overall"), ["slot"]).select("slot", "auc", gini(F.col("auc")).alias("gini"))
    weekly = auc_of_buckets(pairs.where("not overall and week is not null"), ["slot", "week"])
    weekly = weekly.select("slot", "week", gini(F.col("auc")).alias("gini")).where("gini is not null")
    found = total.join(stability_of_weeks(weekly, "week", ["slot"]), ["slot"], "left")
    weights = oof.sparkSession.createDataFrame(
        [(i, *row) for i, row in grid], ", ".join(["slot int", *[f"{n} double" for n in names]])
    )
    out = found.join(F.broadcast(weights), "slot").select(*names, *[c for c in found.columns if c != "slot"])
    return out.orderBy(F.desc("gini"), F.desc("stability"), *names)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


# --- week signal and score shift ------------------------------------------------------------


def restore_week_signal(
    base: DataFrame, refresh: DataFrame | None, naming: Naming = DEFAULT, refresh_date: str = fixed.REFRESH_DATE
) -> DataFrame:
    """key, time_signal: the week column if it holds anything, else the week worked out from the
    earliest refresh date relative to the decision."""
    key = naming.key
    if naming.week in base.columns:
        if base.where(F.col(naming.week).isNotNull()).limit(1).count():
            return base.select(key, F.col(naming.week).cast("double").alias("time_signal"))
    if refresh is None or naming.decision not in base.columns or refresh_date not in refresh.columns:
        return base.select(key, F.lit(None).cast("double").alias("time_signal"))

    def days(df: DataFrame, name: str) -> Column:
        dtype = df.schema[name].dataType
        return F.col(name).cast("int") if isinstance(dtype, T.NumericType) else day_number(F.col(name), dtype)

    # The decision date is constant per case, so the minimum is taken before the join.
    first = refresh.groupBy(key).agg(F.min(days(refresh, refresh_date)).alias("__first"))
    known = base.select(key, days(base, naming.decision).alias("__decision")).join(first, key, "left")
    restored = F.lit(fixed.RESTORE_ANCHOR_DAY) - (F.col("__first") - F.col("__decision"))
    return known.select(key, week_index(restored, fixed.WEEK_ORIGIN_DAY).cast("double").alias("time_signal"))


def time_split_score_shift(
    scores: DataFrame,
    signal: DataFrame,
    divide: float = 0.5,
    reduce_by: float = 0.03,
    key: str = DEFAULT.key,
    enabled: bool = False,
) -> tuple[DataFrame, dict[str, float | int | bool | None]]:
    """Lower the scores of the earlier part of the time span. Off by default.

    This games a time-weighted ranking metric and makes no model better; it exists only so
    that published submissions can be reproduced.
    """
    if not enabled:
        return scores, {"enabled": False}
    joined = scores.join(signal.select(key, "time_signal"), key, "left")
    ends = joined.agg(
        F.min("time_signal").alias("lo"), F.max("time_signal").alias("hi"), F.count("time_signal").alias("n")
    ).first()
    if ends["n"]:
        cutoff = (ends["hi"] - ends["lo"]) * divide + ends["lo"]
        early = F.coalesce(F.col("time_signal") < F.lit(cutoff), F.lit(False))
    else:
        cutoff, early = None, F.lit(False)
    shifted = joined.withColumns(
        {"__before": F.col("score"), "__early": early, "score": F.when(early, clip01(F.col("score") - F.lit(reduce_by))).otherwise(F.col("score"))}
    )
    after = shifted.agg(
        F.coalesce(F.sum(F.col("__early").cast("int")), F.lit(0)).alias("rows"),
        F.avg("__before").alias("before"),
        F.avg("score").alias("after"),
    ).first()
    summary = {
        "enabled": True, "divide": divide, "reduce": reduce_by,
        "time_signal_non_null": ends["n"], "time_signal_min": ends["lo"], "time_signal_max": ends["hi"],
        "cutoff": cutoff, "adjusted_rows": after["rows"],
        "mean_score_before": after["before"], "mean_score_after": after["after"],
    }
    return shifted.select(*scores.columns), summary
