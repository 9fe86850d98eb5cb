"""Metrics, validation windows, blending and post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenkeel.operators import blend as B
from evenkeel.operators import metrics as M
from evenkeel.operators.lab import importance_threshold_drop
from evenkeel.operators.models import fit_gbt, fit_logistic
from evenkeel.operators.skew import unpivot
from evenkeel.plans import validate as V
from evenkeel.queries.bindings import bound_sql, frame, read
from evenkeel.queries.registry import R, bound, query, rounded, with_

# Scores with many ties, made from the given columns.
A_SCORE = "(CAST(floor(o_totalprice / 2500) AS DOUBLE) / 200)"
B_SCORE = "(CAST((o_custkey * 7919) % 1000 AS DOUBLE) / 1000)"
C_SCORE = "(CAST((o_orderkey * 31 + o_custkey) % 97 AS DOUBLE) / 97)"
SCORES = {"lgb": A_SCORE, "xgb": B_SCORE, "cat": C_SCORE}
_S = (
    "s AS (SELECT b.case_id, b.WEEK_NUM, b.target, "
    + ", ".join(f"{e} AS {n}_pred" for n, e in SCORES.items())
    + f" FROM ({bound_sql('base')}) b JOIN orders ON o_orderkey = b.case_id)"
)


def scored(spark, sf):
    base = frame(spark, sf, "base").select("case_id", "WEEK_NUM", "target")
    preds = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), *[F.expr(e).alias(f"{n}_pred") for n, e in SCORES.items()]
    )
    return base.join(preds, "case_id")


def auc_sql(score: str, group: str, origin: str) -> str:
    """Rank-sum AUC with average ranks for ties."""
    by = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    comma = f", {group}, {score}" if group else f", {score}"
    return (
        f"SELECT {keys}(sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0)"
        " / (CAST(sum(target) AS DOUBLE) * sum(1 - target)) AS auc, CAST(count(*) AS BIGINT) AS n, sum(target) AS pos, sum(1 - target) AS neg"
        f" FROM (SELECT *, rank() OVER ({by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {comma[2:]}) - 1) / 2.0 AS rk"
        f" FROM {origin}) {tail}"
    )


@query("auc", f"WITH {_S}, a AS ({auc_sql('lgb_pred', '', 's')}) SELECT n, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, {R('auc', 8)} AS auc FROM a")
def q_auc(spark, sf):
    return rounded(M.auc(scored(spark, sf), "lgb_pred"), 8)


@query("gini", f"WITH {_S}, a AS ({auc_sql('lgb_pred', '', 's')}) SELECT {R('2 * auc - 1', 8)} AS gini FROM a")
def q_gini(spark, sf):
    return rounded(M.auc(scored(spark, sf), "lgb_pred").select(M.gini(F.col("auc")).alias("gini")), 8)


@query(
    "cumulative_rank_auc",
    f"WITH {_S}, c AS (SELECT lgb_pred, CAST(sum(target) AS BIGINT) AS pos, CAST(sum(1 - target) AS BIGINT) AS neg FROM s GROUP BY 1)"
    f" SELECT {R('lgb_pred')} AS lgb_pred, pos, neg, CAST(coalesce(sum(neg) OVER (ORDER BY lgb_pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
    " AS neg_before FROM c",
)
def q_rank(spark, sf):
    counts = M.score_counts(scored(spark, sf), "lgb_pred", "target")
    return rounded(M.cumulative_rank(counts, "lgb_pred").drop("bucket"))


_WEEKLY = f"w AS (SELECT WEEK_NUM, n, 2 * auc - 1 AS gini FROM ({auc_sql('lgb_pred', 'WEEK_NUM', 's')}) WHERE pos > 0 AND neg > 0)"


@query("weekly_gini", f"WITH {_S}, {_WEEKLY} SELECT WEEK_NUM, n, {R('gini', 8)} AS gini FROM w")
def q_weekly(spark, sf):
    return rounded(M.weekly_gini(scored(spark, sf), "lgb_pred"), 8)


def _stability(origin: str, group: str = "") -> str:
    """Stability fields per group from weekly ginis."""
    keys = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    by = f"PARTITION BY {group}" if group else ""
    return (
        f"SELECT {keys}avg(gini) AS mean_gini, max(sl) AS slope, least(0.0, max(sl)) AS falling_rate,"
        " stddev_pop(gini - sl * WEEK_NUM - ic) AS residual_std, CAST(count(*) AS DOUBLE) AS n_weeks,"
        " avg(gini) + 88 * least(0.0, max(sl)) - 0.5 * stddev_pop(gini - sl * WEEK_NUM - ic) AS stability"
        f" FROM (SELECT *, regr_slope(gini, WEEK_NUM) OVER ({by}) AS sl, regr_intercept(gini, WEEK_NUM) OVER ({by}) AS ic"
        f" FROM {origin}) {tail}"
    )


_FIELDS = ("stability", "mean_gini", "slope", "falling_rate", "residual_std", "n_weeks")
_FIELD_SQL = ", ".join(f"{R(c, 6)} AS {c}" for c in _FIELDS)


@query("stability_metric", f"WITH {_S}, {_WEEKLY} SELECT {_FIELD_SQL} FROM ({_stability('w')})")
def q_stability(spark, sf):
    return rounded(M.stability_metric(scored(spark, sf), "lgb_pred"), 6)


@query(
    "fold_windows",
    f"{with_(**bound('base'))}, m AS (SELECT max(WEEK_NUM) AS top FROM base) SELECT CAST(5 - i AS INTEGER) AS fold,"
    " CAST(top - 22 * i - 19 AS INTEGER) AS valid_start, CAST(top - 22 * i AS INTEGER) AS valid_end FROM m, range(5) t(i)"
    " WHERE top - 22 * i - 19 >= 0",
)
def q_windows(spark, sf):
    """Windows of 20 weeks with a gap of 2, from the last week of the orders."""
    windows = V.fold_windows(V.max_week(frame(spark, sf, "base")), 20, 5, 2)
    rows = [(i, a, b) for i, (a, b) in enumerate(windows, start=1)]
    return spark.createDataFrame(rows, "fold int, valid_start int, valid_end int")


@query(
    "holdout_last_weeks",
    f"{with_(**bound('base'))} SELECT case_id, CASE WHEN WEEK_NUM >= (SELECT max(WEEK_NUM) - 19 FROM base) THEN 'valid' ELSE 'train' END"
    " AS role FROM base",
)
def q_holdout(spark, sf):
    train, valid, _ = V.holdout_last_weeks(frame(spark, sf, "base"))
    roles = [d.select("case_id", F.lit(r).alias("role")) for d, r in ((train, "train"), (valid, "valid"))]
    return roles[0].unionByName(roles[1])


_FOLD = "CAST(floor(WEEK_NUM / 60) AS INTEGER) AS fold"
_FOLD_ROWS = (
    f"f AS (SELECT fold, 60 * fold + 59 AS valid_end_week, auc, 2 * auc - 1 AS gini FROM ({auc_sql('lgb_pred', 'fold', 'sf')}))"
)
_SF = f"sf AS (SELECT *, {_FOLD} FROM s)"


def _fold_metrics(spark, sf):
    rows = scored(spark, sf).withColumn("fold", F.floor(F.col("WEEK_NUM") / 60).cast("int"))
    found = M.auc(rows, "lgb_pred", group=["fold"])
    return found.select(
        "fold", (F.col("fold") * 60 + 59).alias("valid_end_week"), "auc", M.gini(F.col("auc")).alias("gini")
    )


def _summary(m):
    return (
        f"SELECT '{m}' AS metric, {R(f'avg({m})', 8)} AS mean, {R(f'min({m})', 8)} AS min, {R(f'max({m})', 8)} AS max,"
        f" {R(f'stddev_pop({m})', 8)} AS std, {R(f'arg_max({m}, valid_end_week)', 8)} AS last_fold FROM f"
    )


@query("fold_summary", f"WITH {_S}, {_SF}, {_FOLD_ROWS} {_summary('auc')} UNION ALL {_summary('gini')}")
def q_fold_summary(spark, sf):
    return rounded(M.fold_summary(_fold_metrics(spark, sf), ["auc", "gini"]), 8)


@query("arg_max_fold", f"WITH {_S}, {_SF}, {_FOLD_ROWS} SELECT fold, CAST(valid_end_week AS INTEGER) AS valid_end_week, {R('auc', 8)} AS auc, {R('gini', 8)} AS gini FROM f ORDER BY valid_end_week DESC LIMIT 1")
def q_last_fold(spark, sf):
    return rounded(M.last_fold(_fold_metrics(spark, sf)), 8)


def _model_sql(group: str, origin: str, score: str, names: str) -> str:
    """AUC, gini and stability per group of a long scored relation."""
    return (
        f"o AS ({auc_sql(score, group, origin)}), wk AS (SELECT *, 2 * auc - 1 AS gini FROM ({auc_sql(score, group + ', WEEK_NUM', origin)})"
        f" WHERE pos > 0 AND neg > 0), st AS ({_stability('wk', group)}) SELECT {names}, {R('auc', 6)} AS auc, {R('2 * auc - 1', 6)} AS gini,"
        f" {_FIELD_SQL} FROM o JOIN st USING ({group})"
    )


_LONG = "l AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, WEEK_NUM, target, {n}_pred AS score FROM s" for n in SCORES
) + ")"


@query("single_model_scores", f"WITH {_S}, {_LONG}, {_model_sql('model', 'l', 'score', 'model')}")
def q_models(spark, sf):
    return rounded(M.single_model_scores(scored(spark, sf), {n: f"{n}_pred" for n in SCORES}), 6)


# The same double arithmetic in the same order on both sides keeps equal blends equal.
_BLEND = (
    "g AS (SELECT a.i / CAST(20 AS DOUBLE) AS wa, b.i / CAST(20 AS DOUBLE) AS wb, (20 - a.i - b.i) / CAST(20 AS DOUBLE) AS wc"
    " FROM range(21) a(i), range(21) b(i) WHERE 20 - a.i - b.i BETWEEN 0 AND 6),"
    " l AS (SELECT wa, wb, wc, WEEK_NUM, target, wa * lgb_pred + wb * xgb_pred + wc * cat_pred AS score FROM g, s)"
)
_W = ", ".join(f"{R(c)} AS {n}_weight" for c, n in (("wa", "lgb"), ("wb", "xgb"), ("wc", "cat")))


@query("blend_weight_search", f"WITH {_S}, {_BLEND}, {_model_sql('wa, wb, wc', 'l', 'score', _W)}")
def q_search(spark, sf):
    found = B.blend_weight_search(scored(spark, sf), {n: f"{n}_pred" for n in SCORES})
    return rounded(found, 6)


@query(
    "sort_report",
    f"WITH {_S}, {_LONG}, o AS ({auc_sql('score', 'model', 'l')}) SELECT model, {R('auc', 8)} AS auc,"
    " CAST(row_number() OVER (ORDER BY auc DESC, model) AS INTEGER) AS place FROM o",
)
def q_sort(spark, sf):
    """The sorted order is kept as a column, results being compared without order."""
    long = unpivot(scored(spark, sf), ["target"], [(n, {"score": F.col(f"{n}_pred")}) for n in SCORES], "model")
    report = M.auc(long, "score", group=["model"]).orderBy(F.desc("auc"), "model")
    place = F.row_number().over(W.orderBy(F.desc("auc"), "model"))
    return rounded(report.select("model", "auc", place.alias("place")), 8)


@query(
    "top_k",
    f"SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def q_top(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(B.top_k(rows, 20, F.desc("o_totalprice"), F.asc("o_orderkey")))


@query("weighted_blend", f"WITH {_S} SELECT case_id, {R('(0.3 * lgb_pred + 0.6 * xgb_pred + 0.1 * cat_pred) / 1.0')} AS score FROM s")
def q_weighted(spark, sf):
    blend = B.weighted_blend({"lgb_pred": 0.3, "xgb_pred": 0.6, "cat_pred": 0.1})
    return rounded(scored(spark, sf).select("case_id", blend.alias("score")))


@query("mean_vote", f"WITH {_S} SELECT case_id, {R('(lgb_pred + xgb_pred + cat_pred) / 3')} AS score FROM s")
def q_vote(spark, sf):
    return rounded(scored(spark, sf).select("case_id", B.mean_vote([f"{n}_pred" for n in SCORES]).alias("score")))


_REFRESH = "credit_bureau_a_1"
_SIGNAL = (
    f"t AS (SELECT b.case_id, CAST(floor((17899 - (min(r.refreshdate_3813885D) - min(b.date_decision)) - 17897) / 7.0) AS DOUBLE) AS time_signal"
    f" FROM ({bound_sql('base')}) b LEFT JOIN ({bound_sql(_REFRESH)}) r USING (case_id) GROUP BY b.case_id)"
)


@query("restore_week_signal", f"WITH {_SIGNAL} SELECT case_id, time_signal FROM t")
def q_restore(spark, sf):
    """The base without its week column."""
    base = frame(spark, sf, "base").drop("WEEK_NUM")
    return B.restore_week_signal(base, frame(spark, sf, _REFRESH).select("case_id", "refreshdate_3813885D"))


@query(
    "time_split_score_shift",
    f"WITH {_S}, e AS (SELECT (max(WEEK_NUM) - min(WEEK_NUM)) * 0.5 + min(WEEK_NUM) AS cut FROM s)"
    f" SELECT case_id, {R('CASE WHEN WEEK_NUM < cut THEN least(1.0, greatest(0.0, lgb_pred - 0.03)) ELSE lgb_pred END')} AS score FROM s, e",
)
def q_shift(spark, sf):
    scores = scored(spark, sf).select("case_id", F.col("lgb_pred").alias("score"))
    signal = B.restore_week_signal(frame(spark, sf, "base"), None)
    return rounded(B.time_split_score_shift(scores, signal, enabled=True)[0])


@query(
    "importance_threshold_drop",
    f"WITH i AS (SELECT o_orderpriority || o_orderstatus AS feature, {R('avg(o_totalprice)', 2)} AS importance_gain FROM orders GROUP BY 1)"
    " SELECT * FROM i WHERE importance_gain < (SELECT avg(o_totalprice) FROM orders)",
)
def q_threshold(spark, sf):
    orders = read(spark, sf, "orders")
    gains = orders.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("feature")).agg(
        F.avg("o_totalprice").alias("importance_gain")
    )
    return importance_threshold_drop(rounded(gains, 2), orders.agg(F.avg("o_totalprice")).first()[0])


@query("week_grouped_stratified_folds")
def q_balanced(spark, sf):
    rows = V.week_grouped_stratified_folds(frame(spark, sf, "base"), 10)
    return rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("WEEK_NUM").alias("weeks"), F.sum("target").alias("hits")
    )


def small_features(spark, sf):
    """Base with the numeric depth-0 columns, for the model queries."""
    base = frame(spark, sf, "base").select("case_id", "WEEK_NUM", "target")
    static = frame(spark, sf, "static_0").drop("firstclxcampaign_1125D")
    return base.join(static, "case_id", "left")


def _quick(df, features):
    return fit_logistic(df, features, max_iter=5)


def _early(df, features, flag):
    return fit_gbt(df, features, validation=flag)


@query("expanding_window_cv")
def q_cv(spark, sf):
    """Boosted trees in five windows of 20 weeks, each stopped early on its window."""
    return V.expanding_window_cv(small_features(spark, sf), _early)


@query("oof_predictions")
def q_oof(spark, sf):
    return V.oof_predictions(small_features(spark, sf), {"boosted": _early, "logit": lambda df, f: fit_logistic(df, f)})


@query("ablation_groups")
def q_ablation(spark, sf):
    wide = small_features(spark, sf).withColumns(
        {"deposit_1__amount__sum": F.col("credamount_770A"), "person_1__inc__max": F.col("annuity_780A")}
    )
    return V.run_ablations(
        wide, "table", _quick, only=["drop_deposit_debitcard", "drop_person_all"], valid_weeks=60, folds=1
    )
