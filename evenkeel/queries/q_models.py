"""Preprocessing, encoders, classifiers and blended scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.scalar import fill_missing
from evenkeel.operators import encode as E
from evenkeel.operators.metrics import auc
from evenkeel.operators.models import fit_forest, fit_gbt, fit_logistic, fit_mlp, refit_all, validation_flag
from evenkeel.operators.profile import profile_columns
from evenkeel.plans.scoring import Branch, score_blend
from evenkeel.plans.validate import fit_with_holdout, holdout_last_weeks, max_week
from evenkeel.queries.bindings import frame, read
from evenkeel.queries.q_metrics import small_features
from evenkeel.queries.registry import R, bound, query, rounded, with_

_STATIC = with_(**bound("base", "static_0", "static_cb_0"))
_FROM = "FROM base LEFT JOIN static_0 USING (case_id) LEFT JOIN static_cb_0 USING (case_id)"


def raw(spark, sf):
    base = frame(spark, sf, "base").select("case_id", "WEEK_NUM", "target")
    static = frame(spark, sf, "static_0").drop("firstclxcampaign_1125D")
    cb = frame(spark, sf, "static_cb_0").drop("responsedate_1012D")
    return base.join(static, "case_id", "left").join(cb, "case_id", "left")


def _state(spark, sf):
    return E.fit_preprocessor(raw(spark, sf), max_missing=0.7, missing_indicator_min_rate=0.2)


_FITTED = (
    "credamount_770A", "annuity_780A", "annuitynextmonth_57A", "currdebt_22A", "disbursedcredamount_1113A", "downpmt_116A",
    "maxannuity_159A", "lastapprcredamount_781A", "applicationcnt_361L", "numberofqueries_373L", "pmtssum_45A", "WEEK_NUM",
)


@query(
    "fit_preprocessor",
    f"{_STATIC}, w AS (SELECT * {_FROM}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'median({c})', 3)} AS fill FROM w" for c in _FITTED),
)
def q_fit(spark, sf):
    """The learned fill values, one row per numeric feature."""
    rows = [(c, v) for c, v in _state(spark, sf).fill_values.items()]
    return rounded(spark.createDataFrame(rows, "feature string, fill double"), 3)


_CODES = (
    "(SELECT education_88M, CAST(row_number() OVER (ORDER BY education_88M) - 1 AS INTEGER) AS code FROM"
    " (SELECT DISTINCT education_88M FROM static_cb_0 WHERE education_88M IS NOT NULL))"
)


def _filled(c):
    return f"{R(f'CAST(CAST(coalesce({c}, (SELECT median({c}) FROM w)) AS FLOAT) AS DOUBLE)', 1)} AS {c}"


_FLAGS = ("annuitynextmonth_57A", "currdebt_22A", "lastapprcredamount_781A")


@query(
    "apply_preprocessor",
    f"{_STATIC}, w AS (SELECT * {_FROM}), k AS {_CODES} SELECT case_id, target, {', '.join(_filled(c) for c in _FITTED)},"
    f" coalesce(code, -1) AS education_88M,"
    f" {', '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}__is_missing' for c in _FLAGS)} FROM w LEFT JOIN k USING (education_88M)",
)
def q_apply(spark, sf):
    return rounded(E.apply_preprocessor(raw(spark, sf), _state(spark, sf), ("case_id", "target")), 1)


@query("missing_indicator", f"{with_(**bound('static_0'))} SELECT case_id, CASE WHEN currdebt_22A IS NULL THEN 1 ELSE 0 END AS currdebt_22A__is_missing, 1 AS gone__is_missing FROM static_0")
def q_missing(spark, sf):
    rows = frame(spark, sf, "static_0")
    return rows.select(
        "case_id", E.missing_indicator("currdebt_22A", True).alias("currdebt_22A__is_missing"),
        E.missing_indicator("gone", False).alias("gone__is_missing"),
    )


@query("category_codes", f"{with_(**bound('static_cb_0'))} SELECT case_id, education_88M, coalesce(code, -1) AS code FROM static_cb_0 LEFT JOIN {_CODES} USING (education_88M)")
def q_codes(spark, sf):
    return E.category_codes(frame(spark, sf, "static_cb_0").select("case_id", "education_88M"), "education_88M", "code")


_GAPPY = ("currdebt_22A", "lastapprcredamount_781A")


@query("median_impute", f"{with_(**bound('static_0'))} SELECT case_id, {', '.join(R(f'coalesce({c}, (SELECT median({c}) FROM static_0))') + f' AS {c}' for c in _GAPPY)} FROM static_0")
def q_impute(spark, sf):
    return rounded(E.median_impute(frame(spark, sf, "static_0").select("case_id", *_GAPPY), _GAPPY))


_COUNT = "CASE WHEN {c} IS NULL THEN -2 ELSE coalesce((SELECT count(*) FROM f WHERE f.{c} = d.{c}), -1) END"


@query(
    "count_encode",
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang, source FROM documents),"
    " f AS (SELECT * FROM d JOIN labels USING (doc_id)),"
    " a AS (SELECT lang, count(*) AS n FROM f GROUP BY 1), b AS (SELECT source, count(*) AS n FROM f GROUP BY 1)"
    " SELECT doc_id, d.lang, d.source, CAST(CASE WHEN d.lang IS NULL THEN -2 ELSE coalesce(a.n, -1) END AS BIGINT) AS lang_cnt,"
    " CAST(CASE WHEN d.source IS NULL THEN -2 ELSE coalesce(b.n, -1) END AS BIGINT) AS source_cnt"
    " FROM d LEFT JOIN a ON a.lang = d.lang LEFT JOIN b ON b.source = d.source",
)
def q_count_encode(spark, sf):
    """Frequencies are learned on the labelled documents and applied to all."""
    lang = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("lang"))
    docs = read(spark, sf, "documents").select("doc_id", lang.alias("lang"), "source")
    return E.count_encode(docs, ["lang", "source"], docs.join(read(spark, sf, "labels").select("doc_id"), "doc_id"))


_NUM = ("credamount_770A", "annuity_780A", "annuitynextmonth_57A", "currdebt_22A", "lastapprcredamount_781A", "applicationcnt_361L")


@query(
    "null_group_columns",
    f"{with_(**bound('static_0'))}, n AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM static_0" for i, c in enumerate(_NUM)
    )
    + ") SELECT nulls, string_agg(feature, ',' ORDER BY i) AS features FROM n GROUP BY 1",
)
def q_null_groups(spark, sf):
    groups = E.null_groups(profile_columns(frame(spark, sf, "static_0"), _NUM))
    return spark.createDataFrame([(k, ",".join(v)) for k, v in groups.items()], "nulls long, features string")


@query("correlation_prune")
def q_prune(spark, sf):
    kept = E.correlation_prune(frame(spark, sf, "static_0"), [*_NUM, "disbursedcredamount_1113A", "maxannuity_159A"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query(
    "fill_missing_const",
    f"{with_(**bound('static_0', 'static_cb_0'))} SELECT case_id, {R('coalesce(lastapprcredamount_781A, -1)')} AS lastapprcredamount_781A,"
    " coalesce(education_88M, 'Missing') AS education_88M FROM static_0 JOIN static_cb_0 USING (case_id)",
)
def q_fill(spark, sf):
    both = frame(spark, sf, "static_0").join(frame(spark, sf, "static_cb_0"), "case_id")
    return rounded(fill_missing(both.select("case_id", "lastapprcredamount_781A", "education_88M"), skip=["case_id"]))


_Z = "coalesce(({c} - (SELECT avg({c}) FROM static_0)) / (SELECT stddev_pop({c}) FROM static_0), 0)"


@query(
    "standardize_features",
    f"{with_(**bound('static_0'))} SELECT case_id, {', '.join(R(_Z.format(c=c)) + f' AS {c}' for c in ('credamount_770A', 'currdebt_22A'))} FROM static_0",
)
def q_standardize(spark, sf):
    names = ["credamount_770A", "currdebt_22A"]
    return rounded(E.standardize_features(frame(spark, sf, "static_0").select("case_id", *names), names))


# --- models ---------------------------------------------------------------------------------


def _ready(spark, sf):
    rows = raw(spark, sf)
    ids = ("case_id", "WEEK_NUM", "target")
    state = E.fit_preprocessor(rows, max_missing=0.9)
    return E.apply_preprocessor(rows, state, ids), [c for c in state.feature_cols if c not in ids], state


@query("fit_gbt")
def q_gbt(spark, sf):
    """Boosted trees on early weeks, stopped on the last 40, AUC on those."""
    rows, features, _ = _ready(spark, sf)
    start = max_week(rows) - 39
    model = fit_gbt(validation_flag(rows, start), features, validation="is_valid")
    scored = model.score(rows.where(F.col("WEEK_NUM") >= start))
    return auc(scored, "score").withColumn("best_iteration", F.lit(model.best_iteration))


@query("fit_second_model")
def q_second(spark, sf):
    rows, features, _ = _ready(spark, sf)
    train, valid, _ = holdout_last_weeks(rows, 40)
    out = None
    for name, model in (
        ("forest", fit_forest(train, features)),
        ("logistic", fit_logistic(train, features)),
    ):
        part = auc(model.score(valid), "score").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("fit_mlp")
def q_mlp(spark, sf):
    rows, features, _ = _ready(spark, sf)
    rows = E.standardize_features(rows, features)
    train, valid, _ = holdout_last_weeks(rows, 40)
    return auc(fit_mlp(train, features).score(valid), "score")


@query("refit_all")
def q_refit(spark, sf):
    """The last weeks tell how many trees to keep, then all rows are fitted with so many."""
    rows = raw(spark, sf)
    model, _, best = fit_with_holdout(
        rows, lambda df, f, flag: fit_gbt(df, f, validation=flag),
        lambda df, f, n: refit_all(df, f, best=n), weeks=40, max_missing=0.9,
    )
    state = E.fit_preprocessor(rows, max_missing=0.9)
    scored = model.score(E.apply_preprocessor(rows, state, ("case_id", "target", "WEEK_NUM")))
    return scored.select("case_id", "score", F.lit(best).alias("best_iteration"))


@query("score_blend")
def q_blend(spark, sf):
    """Two branches with their own features, blended and aligned to every order."""
    rows = raw(spark, sf)
    narrow = small_features(spark, sf)
    branches = {}
    for name, data, weight in (("tree", rows, 0.6), ("linear", narrow, 0.4)):
        state = E.fit_preprocessor(data, max_missing=0.9)
        features = [c for c in state.feature_cols if c != "WEEK_NUM"]
        train = E.apply_preprocessor(data, state, ("case_id", "target", "WEEK_NUM"))
        model = fit_gbt(train, features) if name == "tree" else fit_logistic(train, features)
        # The second branch misses some cases; they get its mean.
        part = data if name == "tree" else data.where(F.col("applicationcnt_361L") > 0)
        branches[name] = (Branch(model, state, weight), part)
    ids = read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    return score_blend(ids, branches)
