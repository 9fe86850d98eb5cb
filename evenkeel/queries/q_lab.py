"""Ranking, profiling and feature reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenkeel.operators import lab as L
from evenkeel.operators import profile as P
from evenkeel.operators.models import fit_gbt
from evenkeel.operators.ordering import rank_first
from evenkeel.queries.bindings import bound_sql, frame, read
from evenkeel.queries.q_metrics import auc_sql, small_features
from evenkeel.queries.registry import R, bound, query, rounded, with_
from evenkeel.session import scratch_path

# The last one is the same for every case that has it.
FEATURES = ("credamount_770A", "annuity_780A", "currdebt_22A", "applicationcnt_361L", "downpmt_116A", "flat_1A")
_W = (
    f"w AS (SELECT b.case_id, b.WEEK_NUM, b.target, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES[:-1])},"
    " CASE WHEN b.case_id % 7 > 0 THEN CAST(3 AS DOUBLE) END AS flat_1A"
    f" FROM ({bound_sql('base')}) b LEFT JOIN ({bound_sql('static_0')}) s USING (case_id))"
)
_LONG = "l AS (" + " UNION ALL ".join(
    f"SELECT case_id, WEEK_NUM, target, '{f}' AS feature, {f} AS x FROM w WHERE {f} IS NOT NULL" for f in FEATURES
) + ")"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x, case_id) AS r, count(*) OVER (PARTITION BY feature) AS n FROM l)"


def _bins(q=10):
    return (
        f"bn AS (SELECT *, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ((r - 1) * {q} + n - 2) // (n - 1)) END AS INTEGER) AS bin FROM r),"
        " bc AS (SELECT feature, bin, CAST(count(*) AS BIGINT) AS rows, CAST(sum(target) AS BIGINT) AS hits FROM bn GROUP BY 1, 2),"
        " fe AS (SELECT feature, min(x) < max(x) AS varies FROM l GROUP BY 1),"
        " vb AS (SELECT bc.* FROM bc JOIN fe USING (feature) WHERE varies)"
    )


_PREP = f"WITH {_W}, {_LONG}, {_RANKED}, {_bins()}"


def wide(spark, sf):
    base = frame(spark, sf, "base").select("case_id", "WEEK_NUM", "target")
    flat = F.when(F.col("case_id") % 7 > 0, F.lit(3.0)).alias("flat_1A")
    static = frame(spark, sf, "static_0").select("case_id", *FEATURES[:-1])
    return base.join(static, "case_id", "left").select("*", flat)


@query("rank_first", f"WITH {_W}, {_LONG}, {_RANKED} SELECT case_id, feature, {R('x')} AS x, CAST(r AS BIGINT) AS r FROM r")
def q_rank(spark, sf):
    return rounded(rank_first(wide(spark, sf), FEATURES, "case_id"))


@query("quantile_bucket", f"{_PREP} SELECT case_id, feature, {R('x')} AS x, CAST(r AS BIGINT) AS r, bin FROM bn")
def q_bucket(spark, sf):
    return rounded(L.quantile_bucket(wide(spark, sf), FEATURES, "case_id"))


@query("adjacent_diff", f"{_PREP} SELECT feature, bin, {R('hits / rows - lag(hits / rows) OVER (PARTITION BY feature ORDER BY bin)')} AS step FROM bc")
def q_diff(spark, sf):
    counts = L.bin_counts(L.quantile_bucket(wide(spark, sf), FEATURES, "case_id", keep=["target"]), "target")
    rate = F.col("hits") / F.col("rows")
    step = rate - F.lag(rate).over(W.partitionBy("feature").orderBy("bin"))
    return rounded(counts.select("feature", "bin", step.alias("step")))


_IV = (
    "iv AS (SELECT feature, sum((p - q) * ln(p / q)) AS iv FROM (SELECT feature,"
    " (hits + 0.5) / sum(hits + 0.5) OVER (PARTITION BY feature) AS p,"
    " (rows + 1.0 - hits - 0.5) / sum(rows + 1.0 - hits - 0.5) OVER (PARTITION BY feature) AS q FROM vb) GROUP BY 1)"
)


@query("information_value", f"{_PREP}, {_IV} SELECT feature, {R('coalesce(iv, 0)', 8)} AS iv FROM fe LEFT JOIN iv USING (feature)")
def q_iv(spark, sf):
    return rounded(L.information_value(wide(spark, sf), FEATURES, "case_id"), 8)


_RATES = (
    "rt AS (SELECT feature, bin, round(CAST(hits AS DOUBLE) / rows, 6) AS rate FROM vb),"
    " sp AS (SELECT *, rate - lag(rate) OVER (PARTITION BY feature ORDER BY bin) AS step FROM rt),"
    " br AS (SELECT feature, '[' || string_agg(CAST(rate AS VARCHAR), ',' ORDER BY bin) || ']' AS bin_target_rates,"
    " coalesce(greatest(avg(CASE WHEN step >= 0 THEN 1.0 WHEN step < 0 THEN 0.0 END), avg(CASE WHEN step <= 0 THEN 1.0 WHEN step > 0 THEN 0.0 END)), 0)"
    " AS bin_monotonic_score FROM sp GROUP BY 1)"
)


@query("bin_target_rates", f"{_PREP}, {_RATES} SELECT feature, coalesce(bin_target_rates, '[]') AS bin_target_rates,"
    f" {R('coalesce(bin_monotonic_score, 0)')} AS bin_monotonic_score FROM fe LEFT JOIN br USING (feature)")
def q_rates(spark, sf):
    return rounded(L.bin_target_rates(wide(spark, sf), FEATURES, "case_id"))


_PSI = (
    "dw AS (SELECT DISTINCT feature, WEEK_NUM FROM l),"
    " cut AS (SELECT feature, max(CASE WHEN i = n // 2 THEN WEEK_NUM END) AS split FROM (SELECT *,"
    " row_number() OVER (PARTITION BY feature ORDER BY WEEK_NUM) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM dw) GROUP BY 1),"
    " lt AS (SELECT l.*, WEEK_NUM <= split AS early FROM l JOIN cut USING (feature)),"
    " ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e"
    " FROM lt WHERE early GROUP BY 1),"
    " sl AS (SELECT lt.feature, early, CASE WHEN x = e[len(e)] THEN len(e) - 1 ELSE len(list_filter(e, lambda v: v <= x)) END AS slot, len(e) AS k"
    " FROM lt JOIN ed USING (feature)),"
    " hs AS (SELECT feature, k, slot, sum(CASE WHEN early THEN 1.0 ELSE 0 END) AS ref, sum(CASE WHEN early THEN 0.0 ELSE 1 END) AS cur"
    " FROM sl WHERE slot BETWEEN 1 AND k - 1 AND k > 2 GROUP BY 1, 2, 3),"
    " ps AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM (SELECT feature,"
    " (ref + 0.5) / (sum(ref) OVER (PARTITION BY feature) + 0.5 * (k - 1)) AS p,"
    " (cur + 0.5) / (sum(cur) OVER (PARTITION BY feature) + 0.5 * (k - 1)) AS q FROM hs) GROUP BY 1)"
)


@query("psi_by_time", f"WITH {_W}, {_LONG}, {_PSI} SELECT feature, {R('coalesce(psi, 0)', 8)} AS psi FROM (SELECT DISTINCT feature FROM l) LEFT JOIN ps USING (feature)")
def q_psi(spark, sf):
    return rounded(L.psi_by_time(wide(spark, sf), FEATURES), 8)


_AUC = f"ua AS (SELECT feature, coalesce(greatest(auc, 1 - auc), 0.5) AS univariate_auc FROM ({auc_sql('x', 'feature', 'l')}))"


@query("univariate_auc", f"WITH {_W}, {_LONG}, {_AUC} SELECT feature, {R('univariate_auc', 8)} AS univariate_auc FROM ua")
def q_uauc(spark, sf):
    return rounded(L.univariate_auc(wide(spark, sf), FEATURES), 8)


_BASICS = "ba AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate, CAST(count(DISTINCT {f}) AS BIGINT) AS nunique FROM w"
    for f in FEATURES
) + ")"


@query(
    "feature_report",
    f"{_PREP}, {_IV}, {_RATES}, {_PSI}, {_AUC}, {_BASICS} SELECT feature, {R('missing_rate', 6)} AS missing_rate, nunique, {R('coalesce(iv, 0)', 6)} AS iv,"
    f" {R('coalesce(psi, 0)', 6)} AS psi, {R('univariate_auc', 6)} AS univariate_auc, coalesce(bin_target_rates, '[]') AS bin_target_rates,"
    f" {R('coalesce(bin_monotonic_score, 0)', 6)} AS bin_monotonic_score"
    " FROM ba LEFT JOIN iv USING (feature) LEFT JOIN ps USING (feature) JOIN ua USING (feature) LEFT JOIN br USING (feature)",
)
def q_report(spark, sf):
    return rounded(L.feature_report(wide(spark, sf), FEATURES, "case_id"), 6)


# --- profiles -------------------------------------------------------------------------------

_PROFILED = {
    "static_0__credamount_770A": ("credamount_770A", "double"),
    "static_0__currdebt_22A": ("currdebt_22A", "double"),
    "applprev_1__copy__max": ("credamount_770A", "double"),
    "applprev_1__fixed__min": ("1", "int"),
    "applicationcnt_361L": ("applicationcnt_361L", "bigint"),
    "education_88M": ("education_88M", "string"),
}


def profiled(spark, sf):
    both = frame(spark, sf, "static_0").join(frame(spark, sf, "static_cb_0"), "case_id")
    return both.select("case_id", *[F.expr(e).alias(n) for n, (e, _) in _PROFILED.items()])


_PW = (
    f"pw AS (SELECT case_id, {', '.join(f'{e} AS {n}' for n, (e, _) in _PROFILED.items())} FROM ({bound_sql('static_0')})"
    f" JOIN ({bound_sql('static_cb_0')}) USING (case_id))"
)


def _names(n):
    return (n.split("__", 1)[0], n.rsplit("__", 1)[-1]) if "__" in n else ("base_or_derived", "raw_or_derived")


_PROFILE = "pf AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, '{t}' AS dtype, '{_names(n)[0]}' AS table_prefix, '{_names(n)[1]}' AS agg_suffix,"
    f" avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate, CAST(count(DISTINCT {n}) AS BIGINT) AS nunique,"
    f" count(DISTINCT {n}) <= 1 AS is_constant FROM pw"
    for n, (_, t) in _PROFILED.items()
) + ")"


@query("feature_profile", f"WITH {_PW}, {_PROFILE} SELECT * EXCLUDE (missing_rate), {R('missing_rate')} AS missing_rate FROM pf")
def q_profile(spark, sf):
    return rounded(P.feature_profile(profiled(spark, sf), list(_PROFILED)))


_TWIN = (
    "dp AS (SELECT 'applprev_1__copy__max' AS feature, 'static_0__credamount_770A' AS duplicate_of FROM pw"
    " HAVING sum(CASE WHEN applprev_1__copy__max IS DISTINCT FROM static_0__credamount_770A THEN 1 ELSE 0 END) = 0)"
)


@query("duplicate_columns", f"WITH {_PW}, {_TWIN} SELECT * FROM dp")
def q_twins(spark, sf):
    return P.duplicate_report(profiled(spark, sf), list(_PROFILED), "case_id")


def _with_twins(spark, sf):
    rows = profiled(spark, sf)
    names = list(_PROFILED)
    return P.feature_profile(rows, names).join(P.duplicate_report(rows, names, "case_id"), "feature", "left")


for _by, _name in (("table_prefix", "profile_by_table"), ("agg_suffix", "profile_by_agg")):

    @query(
        _name,
        f"WITH {_PW}, {_PROFILE}, {_TWIN} SELECT {_by}, CAST(count(*) AS BIGINT) AS features, {R('avg(missing_rate)')} AS mean_missing,"
        f" {R('max(missing_rate)')} AS max_missing, CAST(sum(CASE WHEN is_constant THEN 1 ELSE 0 END) AS BIGINT) AS constant_features,"
        f" CAST(count(duplicate_of) AS BIGINT) AS duplicate_features FROM pf LEFT JOIN dp USING (feature) GROUP BY 1",
    )
    def _roll(spark, sf, by=_by):
        return rounded(P.roll_up(_with_twins(spark, sf), by))


_RAW = ("pmts_dpd_1073P", "pmts_overdue_1140A")
_PAY = "credit_bureau_a_2"


@query(
    "raw_profile_by_file",
    with_(**bound(_PAY))
    + " "
    + " UNION ALL ".join(
        f"SELECT 'part=' || (case_id % 3) AS file, '{c}' AS feature, CAST(count(*) AS BIGINT) AS rows,"
        f" {R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate, {R(f'CAST(min({c}) AS DOUBLE)')} AS min,"
        f" {R(f'CAST(max({c}) AS DOUBLE)')} AS max, {R(f'avg({c})')} AS mean FROM {_PAY} GROUP BY 1"
        for c in _RAW
    ),
)
def q_raw(spark, sf):
    """Profile per input file, on payments written in three parts."""
    path = scratch_path(spark, "payments")
    frame(spark, sf, _PAY).withColumn("part", F.col("case_id") % 3).write.partitionBy("part").parquet(path)
    rows = spark.read.parquet(path)
    named = rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"(part=\d+)/", 1))
    return rounded(P.null_profile_by_file(named, _RAW))


# --- importance and drop lists ----------------------------------------------------------------

_GAIN_CTE = (
    f"ig AS (SELECT o_orderpriority || '_' || o_orderstatus AS feature, {R('sum(o_totalprice) / 1000000', 3)} AS importance_gain,"
    f" {R('stddev_samp(o_totalprice) / 50000', 3)} AS psi FROM orders GROUP BY 1)"
)


def _gains(spark, sf):
    return rounded(
        read(spark, sf, "orders").groupBy(F.concat_ws("_", "o_orderpriority", "o_orderstatus").alias("feature")).agg(
            (F.sum("o_totalprice") / 1000000).alias("importance_gain"),
            (F.stddev_samp("o_totalprice") / 50000).alias("psi"),
        ),
        3,
    )


@query("rank_min_desc", f"WITH {_GAIN_CTE} SELECT feature, importance_gain, psi, CAST(rank() OVER (ORDER BY importance_gain DESC) AS INTEGER) AS gain_rank FROM ig")
def q_rank_min(spark, sf):
    return L.rank_min_desc(_gains(spark, sf), "importance_gain", "gain_rank")


_LIMITS = dict(max_gain_duplicate=100.0, high_psi=1.5, max_gain_high_psi=90.0)


@query(
    "build_drop_list",
    f"WITH {_GAIN_CTE}, d AS (SELECT feature, regexp_replace(feature, '_[FOP]$', '_O') AS duplicate_of FROM ig WHERE feature LIKE '%_P'),"
    " c AS (SELECT feature, 1 AS step, 'duplicate_of:' || d.duplicate_of AS reason FROM d JOIN ig USING (feature)"
    " LEFT JOIN (SELECT feature AS duplicate_of, importance_gain AS og FROM ig) o USING (duplicate_of)"
    " WHERE importance_gain <= 100 OR coalesce(og, 0) >= importance_gain"
    " UNION ALL SELECT feature, 2, 'constant_in_profile_sample' FROM ig WHERE feature LIKE '1%'"
    " UNION ALL SELECT feature, 3, 'high_psi_low_gain:' || printf('%.4f', psi) FROM ig WHERE psi >= 1.5 AND importance_gain <= 90)"
    " SELECT feature, arg_min(reason, step) AS reason FROM c GROUP BY 1",
)
def q_drop(spark, sf):
    gains = _gains(spark, sf)
    twins = gains.where("feature LIKE '%_P'").select("feature", F.regexp_replace("feature", "_[FOP]$", "_O").alias("duplicate_of"))
    profile = gains.select("feature", F.col("feature").startswith("1").alias("is_constant"))
    return L.build_drop_list(profile, twins, gains, **_LIMITS)


@query("importance_report")
def q_importance(spark, sf):
    rows = small_features(spark, sf).fillna(0.0)
    model = fit_gbt(rows, FEATURES[:-1])
    report = L.information_value(wide(spark, sf), FEATURES[:-1], "case_id")
    return rounded(L.importance_report(model.importances(rows), report))
