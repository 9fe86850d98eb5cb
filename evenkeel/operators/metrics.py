"""AUC, Gini and the weekly stability metric, exact and tie-aware."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenkeel.operators.ordering import Cuts, find_cuts, running_before
from evenkeel.operators.skew import unpivot

SLOPE_PENALTY = 88.0
RESIDUAL_PENALTY = 0.5


def score_counts(
    df: DataFrame, score: str, target: str, group: Sequence[str] = (), buckets: int | None = None, cuts: Cuts | None = None
) -> DataFrame:
    """Positives and negatives per distinct score, with the score's bucket."""
    if cuts is None:
        cuts = find_cuts(df, {score: F.col(score)}, buckets)[score]
    hits = F.sum(F.col(target).cast("long"))
    return (
        df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(target).isNotNull())
        .groupBy(*group, score, cuts.bucket(F.col(score)).alias("bucket"))
        .agg(hits.alias("pos"), (F.count(F.lit(1)) - hits).alias("neg"))
    )


def cumulative_rank(counts: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Adds ``neg_before``, the negatives with a lower score of the same group."""
    return running_before(counts, group, "bucket", [score], ["neg"])


def auc_of_counts(counts: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """group, n, pos, neg, auc; auc is null for groups with one class.

    Pairs won inside a bucket come from a window over the bucket; pairs won against lower
    buckets from the bucket totals. No row needs its global rank, so nothing is joined.
    """
    group = list(group)
    inside = W.partitionBy(*group, "bucket").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("neg") / F.lit(2.0)
    buckets = (
        counts.select(*group, "bucket", "pos", "neg", (F.col("pos").cast("double") * below).alias("won"))
        .groupBy(*group, "bucket")
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won")])
    )
    return auc_of_buckets(buckets, group)


def auc_of_buckets(buckets: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The same from one row per group and bucket: pos, neg, and the pairs won inside the bucket, ties counting half."""
    group = list(group)
    lower = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    won = F.col("won") + F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    sums = buckets.select(*group, "pos", "neg", won.alias("won")).groupBy(*group).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum("won").alias("won"),
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return sums.select(*group, "n", "pos", "neg", F.when(pairs > 0, F.col("won") / pairs).alias("auc"))


def auc(
    df: DataFrame, score: str, target: str = "target", group: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    return auc_of_counts(score_counts(df, score, target, group, buckets), score, group)


def gini(auc_column: Column) -> Column:
    return 2 * auc_column - 1


def weekly_gini(
    df: DataFrame,
    score: str,
    target: str = "target",
    week: str = "WEEK_NUM",
    group: Sequence[str] = (),
    buckets: int | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Gini per week; weeks with a single class are left out."""
    counts = score_counts(df.where(F.col(week).isNotNull()), score, target, [*group, week], buckets, cuts)
    weekly = auc_of_counts(counts, score, [*group, week]).where(F.col("auc").isNotNull())
    return weekly.select(*group, week, "n", gini(F.col("auc")).alias("gini"))


def stability_of_weeks(
    weekly: DataFrame,
    week: str = "WEEK_NUM",
    group: Sequence[str] = (),
    slope_penalty: float = SLOPE_PENALTY,
    residual_penalty: float = RESIDUAL_PENALTY,
) -> DataFrame:
    """Mean gini, penalised for a falling trend and for scatter around it.

    Works on one row per week, so the windows below hold as many rows as there are weeks.
    Fewer than two weeks give NaN.
    """
    w = W.partitionBy(*group)
    x, y = F.col(week).cast("double"), F.col("gini")
    fitted = weekly.select(
        *group,
        y.alias("gini"),
        F.regr_slope(y, x).over(w).alias("slope"),
        (y - F.regr_slope(y, x).over(w) * x - F.regr_intercept(y, x).over(w)).alias("residual"),
    )
    stats = fitted.groupBy(*group).agg(
        F.avg("gini").alias("mean_gini"),
        F.max("slope").alias("slope"),
        F.stddev_pop("residual").alias("residual_std"),
        F.count(F.lit(1)).cast("double").alias("n_weeks"),
    )
    nan = F.lit(float("nan"))
    enough = F.col("n_weeks") >= 2
    falling = F.least(F.lit(0.0), F.col("slope"))
    stability = F.col("mean_gini") + slope_penalty * falling - residual_penalty * F.col("residual_std")

    def field(c: Column, name: str) -> Column:
        return F.when(enough, F.coalesce(c, nan)).otherwise(nan).alias(name)

    return stats.select(
        *group,
        field(stability, "stability"),
        field(F.col("mean_gini"), "mean_gini"),
        field(F.col("slope"), "slope"),
        field(falling, "falling_rate"),
        field(F.col("residual_std"), "residual_std"),
        "n_weeks",
    )


def stability_metric(
    df: DataFrame,
    score: str,
    target: str = "target",
    week: str = "WEEK_NUM",
    group: Sequence[str] = (),
    slope_penalty: float = SLOPE_PENALTY,
    residual_penalty: float = RESIDUAL_PENALTY,
    buckets: int | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    weekly = weekly_gini(df, score, target, week, group, buckets, cuts)
    return stability_of_weeks(weekly, week, group, slope_penalty, residual_penalty)


def score_groups(
    df: DataFrame,
    score: str,
    group: Sequence[str],
    target: str = "target",
    week: str = "WEEK_NUM",
    cuts: Cuts | None = None,
) -> DataFrame:
    """AUC, gini and stability per group. The scores are collapsed once per week; the overall
    counts are rolled up from those."""
    if cuts is None:
        cuts = find_cuts(df, {score: F.col(score)})[score]
    by_week = score_counts(df, score, target, [*group, week], cuts=cuts)
    overall = by_week.groupBy(*group, score, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = auc_of_counts(overall, score, group).select(*group, "auc", gini(F.col("auc")).alias("gini"))
    # Rows without a week are carried along and drop out by a value that is known only after the counts: a plain
    # filter would sink below the aggregate and split the shared counts into two.
    known = F.when(F.col(week).isNotNull(), gini(F.col("auc")))
    weekly = auc_of_counts(by_week, score, [*group, week]).select(*group, week, known.alias("gini")).where("gini is not null")
    return total.join(stability_of_weeks(weekly, week, group), list(group), "left")


def single_model_scores(
    df: DataFrame, models: Mapping[str, str], target: str = "target", week: str = "WEEK_NUM"
) -> DataFrame:
    """One row per prediction column, best gini first."""
    long = unpivot(df, [target, week], [(name, {"score": F.col(c).cast("double")}) for name, c in models.items()], "model")
    return score_groups(long, "score", ["model"], target, week).orderBy(F.desc("gini"), "model")


def fold_summary(folds: DataFrame, metrics: Sequence[str], end: str = "valid_end_week") -> DataFrame:
    """metric, mean, min, max, population std (NaN skipped) and the value of the last fold."""
    long = unpivot(folds, [end], [(m, {"value": F.col(m).cast("double")}) for m in metrics], "metric")
    clean = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy("metric").agg(
        F.avg(clean).alias("mean"),
        F.min(clean).alias("min"),
        F.max(clean).alias("max"),
        F.stddev_pop(clean).alias("std"),
        F.max_by("value", end).alias("last_fold"),
    )


def last_fold(folds: DataFrame, end: str = "valid_end_week") -> DataFrame:
    """The fold with the latest validation window."""
    return folds.agg(F.max_by(F.struct(*folds.columns), F.col(end)).alias("f")).select("f.*")
