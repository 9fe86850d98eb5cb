"""Feature laboratory: information value, stability over time, univariate AUC, reports.

All features of a report share one narrow (feature, value) form; nothing loops over columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenkeel.functions.scalar import log_ratio_term
from evenkeel.operators.joins import merge_reports
from evenkeel.operators.metrics import auc_of_counts
from evenkeel.operators.ordering import Cuts, blocks, find_cuts, known_number, quantiles_of_counts, rank_first, value_counts


def column_sizes(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[int, bool]]:
    """How many numbers each feature holds and whether they vary; one row."""
    cells = []
    for i, f in enumerate(features):
        x = known_number(F.col(f))
        cells += [F.count(x).alias(f"n{i}"), (F.min(x) < F.max(x)).alias(f"v{i}")]
    row = df.agg(*cells).first()
    return {f: (row[f"n{i}"], bool(row[f"v{i}"])) for i, f in enumerate(features)}


def quantile_bucket(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    bins: int = 10,
    keep: Sequence[str] = (),
    cuts: Mapping[str, Cuts] | None = None,
    sizes: Mapping[str, tuple[int, bool]] | None = None,
) -> DataFrame:
    """Equal-frequency bin (from 1) of every non-null value, ties split in row order.

    Integer form of cutting positions 1..n at evenly spaced quantiles. The sizes stand in the plan as literals,
    so the ranked rows are read once.
    """
    sizes = sizes or column_sizes(df, features)
    ranked = rank_first(df, features, row_id, keep, cuts=cuts)
    held = F.create_map(*[F.lit(x) for f in features for x in (f, sizes[f][0])])
    bin_of = F.expr(f"CASE WHEN n = 1 THEN 1 ELSE greatest(1, ((r - 1) * {bins} + n - 2) div (n - 1)) END")
    return ranked.withColumn("n", held[F.col("feature")]).select(row_id, *keep, "feature", "x", "r", bin_of.cast("int").alias("bin"))


def _varying_bins(df, features, row_id, target, bins, cuts=None, sizes=None) -> DataFrame | None:
    """Bin counts of the features that vary; others have no bins."""
    sizes = sizes or column_sizes(df, features)
    varying = [f for f in features if sizes[f][1]]
    if not varying:
        return None
    return bin_counts(quantile_bucket(df, varying, row_id, bins, [target], cuts, sizes), target)


def _for_all(df: DataFrame, features: Sequence[str], found: DataFrame | None, empty: Mapping[str, object]) -> DataFrame:
    """A row for every feature, with the given values where nothing was found."""
    labels = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    if found is None:
        return labels.select("feature", *[F.lit(v).alias(c) for c, v in empty.items()])
    return labels.join(found, "feature", "left").fillna(dict(empty))


def bin_counts(binned: DataFrame, target: str) -> DataFrame:
    """feature, bin, rows and positives."""
    return binned.groupBy("feature", "bin").agg(
        F.count(target).alias("rows"), F.sum(F.col(target).cast("long")).alias("hits")
    )


def information_value_of_bins(bins: DataFrame) -> DataFrame:
    """Smoothed information value; at most ``bins`` rows per feature enter the window."""
    w = W.partitionBy("feature")
    bad = F.col("hits") + 0.5
    good = F.col("rows") + 1.0 - bad
    shares = bins.select(
        "feature", (bad / F.sum(bad).over(w)).alias("p"), (good / F.sum(good).over(w)).alias("q")
    )
    return shares.groupBy("feature").agg(F.sum(log_ratio_term(F.col("p"), F.col("q"))).alias("iv"))


def information_value(
    df: DataFrame, features: Sequence[str], row_id: str, target: str = "target", bins: int = 10
) -> DataFrame:
    """Information value; 0 for features that don't vary."""
    counts = _varying_bins(df, features, row_id, target, bins)
    return _for_all(df, features, None if counts is None else information_value_of_bins(counts), {"iv": 0.0})


def listed_json(order: str, value: str) -> Column:
    """Aggregate: the values of a group as a JSON list, in order. For groups of bounded size, such as bins."""
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]))


def bin_target_rates_of_bins(bins: DataFrame) -> DataFrame:
    """Target rate per bin as a JSON list, and how monotonic the rates are."""
    w = W.partitionBy("feature").orderBy("bin")
    rate = F.round(F.col("hits") / F.col("rows"), 6)
    rates = bins.select("feature", "bin", rate.alias("rate"))
    steps = rates.select("feature", "bin", "rate", (F.col("rate") - F.lag("rate").over(w)).alias("step"))
    up = F.avg((F.col("step") >= 0).cast("int"))
    down = F.avg((F.col("step") <= 0).cast("int"))
    return steps.groupBy("feature").agg(
        listed_json("bin", "rate").alias("bin_target_rates"),
        F.coalesce(F.greatest(up, down), F.lit(0.0)).alias("bin_monotonic_score"),
    )


def bin_target_rates(
    df: DataFrame, features: Sequence[str], row_id: str, target: str = "target", bins: int = 10
) -> DataFrame:
    """Rates by bin; features that don't vary have none."""
    counts = _varying_bins(df, features, row_id, target, bins)
    none = {"bin_target_rates": "[]", "bin_monotonic_score": 0.0}
    return _for_all(df, features, None if counts is None else bin_target_rates_of_bins(counts), none)


def week_splits(df: DataFrame, features: Sequence[str], week: str = "WEEK_NUM") -> dict[str, int]:
    """Middle distinct week per feature, over rows where it has a value; none below four weeks.

    The sets gathered here are as long as the calendar, whatever the number of rows.
    """
    row = df.agg(
        *[F.sort_array(F.collect_set(F.when(F.col(f).isNotNull(), F.col(week)))).alias(f"w{i}") for i, f in enumerate(features)]
    ).first()
    weeks = {f: row[f"w{i}"] for i, f in enumerate(features)}
    return {f: w[len(w) // 2] for f, w in weeks.items() if len(w) >= 4}


def psi_by_time(
    df: DataFrame, features: Sequence[str], week: str = "WEEK_NUM", bins: int = 10
) -> DataFrame:
    """Population stability between the earlier and the later weeks, 0 where undefined.

    Bin edges are exact quantiles of the earlier part; the last bin is closed and later
    values outside the edges are left out.
    """
    labels = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    splits = week_splits(df, features, week)
    if not splits:
        return labels.select("feature", F.lit(0.0).alias("psi"))
    counts = value_counts(
        df.where(F.col(week).isNotNull()), {f: F.col(f) for f in splits}, period_measures(splits, week)
    )
    return psi_of_counts(counts, features, bins)


def period_measures(splits: Mapping[str, int], week: str) -> dict[str, Callable[[str], Column]]:
    """Rows of the earlier and the later part, the split week differing by feature."""

    def part(f: str, early: bool) -> Column:
        if f not in splits:
            return F.lit(0).cast("long")
        side = F.col(week) <= splits[f] if early else F.col(week) > splits[f]
        return F.coalesce(side.cast("long"), F.lit(0))

    return {"ref": lambda f: part(f, True), "cur": lambda f: part(f, False)}


def psi_of_counts(counts: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability from (feature, x, bucket, ref, cur) counts."""
    labels = counts.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    ref = counts.where(F.col("ref") > 0).select("feature", "x", "bucket", F.col("ref").alias("n"))
    cut = quantiles_of_counts(ref, [i / bins for i in range(bins + 1)], most_rows=2 * len(features) * (bins + 1))
    # bins + 1 numbers per feature.
    edges = cut.groupBy("feature").agg(F.array_sort(F.collect_set("q")).alias("edges"))
    last = F.size("edges")
    passed = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    slot = F.when(F.col("x") == F.element_at("edges", -1), last - 1).otherwise(passed)
    placed = counts.join(F.broadcast(edges), "feature").where(last > 2).select(
        "feature", last.alias("k"), slot.alias("slot"), "ref", "cur"
    )
    inside = placed.where((F.col("slot") >= 1) & (F.col("slot") < F.col("k")))
    hist = inside.groupBy("feature", "k", "slot").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    # Bins that hold nothing still count, with the smoothing alone.
    slots = edges.where(last > 2).select(
        "feature", last.alias("k"), F.explode(F.sequence(F.lit(1), last - 1)).alias("slot")
    )
    full = slots.join(hist, ["feature", "k", "slot"], "left").fillna(0, ["ref", "cur"])
    w = W.partitionBy("feature")

    def share(name: str) -> Column:
        return (F.col(name) + 0.5) / (F.sum(name).over(w) + 0.5 * (F.col("k") - 1))

    parts = full.select("feature", share("ref").alias("p"), share("cur").alias("q"))
    psi = parts.groupBy("feature").agg(F.sum(log_ratio_term(F.col("q"), F.col("p"))).alias("psi"))
    return labels.join(psi, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def univariate_auc(
    df: DataFrame, features: Sequence[str], target: str = "target"
) -> DataFrame:
    """max(auc, 1 - auc) per feature; 0.5 when values or classes do not vary."""
    known = df.where(F.col(target).isNotNull())
    counts = value_counts(known, {f: F.col(f) for f in features}, class_measures(target))
    return auc_of_feature_counts(counts, features)


def class_measures(target: str) -> dict[str, Column]:
    hit = F.col(target).cast("long")
    return {"pos": F.coalesce(hit, F.lit(0)), "neg": F.coalesce(1 - hit, F.lit(0))}


def auc_of_feature_counts(counts: DataFrame, features: Sequence[str]) -> DataFrame:
    scored = auc_of_counts(counts, "x", ["feature"])
    labels = counts.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    both = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return labels.join(scored, "feature", "left").select(
        "feature", F.coalesce(both, F.lit(0.5)).alias("univariate_auc")
    )


def feature_report(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    target: str = "target",
    week: str = "WEEK_NUM",
    bins: int = 10,
) -> DataFrame:
    """One row per feature: missing rate, distinct count, IV, PSI, univariate AUC and bin rates."""
    # Rows, sizes and middle weeks once for all features.
    total, sizes, splits = df.count(), {}, {}
    for block in blocks(features):
        sizes |= column_sizes(df, block)
        splits |= week_splits(df, block, week)
    parts = [_report_block(df, block, row_id, target, week, bins, total, sizes, splits) for block in blocks(features)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return sort_report(out)


def _report_block(df, features, row_id, target, week, bins, total, sizes, splits) -> DataFrame:
    columns = {f: F.col(f) for f in features}
    cuts = find_cuts(df, {**columns, "__row": F.col(row_id)})
    counted = _varying_bins(df, features, row_id, target, bins, cuts, sizes)
    # One collapse to distinct values serves distinct counts, PSI and AUC.
    splits = {f: w for f, w in splits.items() if f in columns}
    counts = value_counts(df, columns, {**class_measures(target), **period_measures(splits, week)}, cuts=cuts)
    held = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("nunique"))
    n = F.create_map(*[F.lit(x) for f in features for x in (f, sizes[f][0])])[F.col("feature")]
    out = _for_all(df, features, held, {"nunique": 0}).select("feature", (1 - n / F.lit(total)).alias("missing_rate"), "nunique")
    parts = [psi_of_counts(counts, features, bins), auc_of_feature_counts(counts, features)]
    if counted is not None:
        parts += [information_value_of_bins(counted), bin_target_rates_of_bins(counted)]
    else:
        parts.append(_for_all(df, features, None, {"iv": 0.0, "bin_target_rates": "[]", "bin_monotonic_score": 0.0}))
    for part in parts:
        out = out.join(part, "feature", "left")
    return out.fillna({"iv": 0.0, "bin_target_rates": "[]", "bin_monotonic_score": 0.0}).select(
        "feature", "missing_rate", "nunique", "iv", "psi", "univariate_auc", "bin_target_rates", "bin_monotonic_score"
    )


def sort_report(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("iv"), F.desc("univariate_auc"), F.asc("psi"), "feature")


def rank_min_desc(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank from the largest value, ties sharing the smallest rank. For reports: one row per
    feature, so the single window partition is as long as the feature list."""
    return df.withColumn(out, F.rank().over(W.orderBy(F.desc(value))).cast("int"))


def importance_report(importance: DataFrame, report: DataFrame | None = None) -> DataFrame:
    out = rank_min_desc(importance, "importance_gain", "gain_rank")
    by = ["importance_gain"]
    if "importance_split" in importance.columns:
        out, by = rank_min_desc(out, "importance_split", "split_rank"), [*by, "importance_split"]
    if report is not None:
        wanted = ["missing_rate", "nunique", "iv", "psi", "univariate_auc", "bin_monotonic_score"]
        out = merge_reports(out, report, wanted)
    return out.orderBy(*[F.desc(c) for c in by], "feature")


def importance_threshold_drop(importance: DataFrame, limit: float = 80, column: str = "importance_gain") -> DataFrame:
    """Features whose importance is below the limit."""
    return importance.where(F.col(column) < limit)


def build_drop_list(
    profile: DataFrame,
    duplicates: DataFrame,
    importance: DataFrame,
    max_gain_duplicate: float = 1000.0,
    high_psi: float = 2.0,
    max_gain_high_psi: float = 2000.0,
) -> DataFrame:
    """feature, reason. The first reason that applies wins: duplicate, constant, unstable."""
    gains = importance.select("feature", F.col("importance_gain").alias("gain"))
    original = gains.select(F.col("feature").alias("duplicate_of"), F.col("gain").alias("original_gain"))
    twins = duplicates.join(gains, "feature", "left").join(original, "duplicate_of", "left")
    own, other = F.coalesce("gain", F.lit(0.0)), F.coalesce("original_gain", F.lit(0.0))
    by_copy = twins.where((own <= max_gain_duplicate) | (other >= own)).select(
        "feature", F.lit(1).alias("step"), F.concat(F.lit("duplicate_of:"), "duplicate_of").alias("reason")
    )
    by_constant = profile.where("is_constant").select(
        "feature", F.lit(2).alias("step"), F.lit("constant_in_profile_sample").alias("reason")
    )
    out = by_copy.unionByName(by_constant)
    if "psi" in importance.columns:
        shaky = importance.where((F.col("psi") >= high_psi) & (F.col("importance_gain") <= max_gain_high_psi))
        text = F.concat(F.lit("high_psi_low_gain:"), F.format_string("%.4f", "psi"))
        out = out.unionByName(shaky.select("feature", F.lit(3).alias("step"), text.alias("reason")))
    return out.groupBy("feature").agg(F.min_by("reason", "step").alias("reason")).orderBy("feature")
