"""Derived feature groups on the columns they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.scalar import normalize_dates
from evenkeel.operators.derived import derive
from evenkeel.operators.hierarchy import aggregate_two_stage
from evenkeel.plans.wide import aggregate_group, decision_dates
from evenkeel.queries.bindings import bound_sql, frame, source
from evenkeel.queries.q_hierarchy import _CASE, _CASE_STATS, _CONTRACT_CTE, G, _P
from evenkeel.queries.registry import R, bound, query, rounded, with_
from evenkeel.sources.tables import load_base


def _ratio(a, b):
    return f"CASE WHEN abs({b}) > 1e-6 THEN {a} / {b} END"


def _div(a, b):
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def _select(cells: dict[str, str], origin: str, ctes: str) -> str:
    return f"{ctes} SELECT case_id, " + ", ".join(f'{R(e)} AS "{n}"' for n, e in cells.items()) + f" FROM {origin}"


def _new(spark, sf, wide, feature_set):
    """case_id and the columns the feature set added."""
    out = derive(wide, feature_set)
    return rounded(out.select("case_id", *[c for c in out.columns if c not in wide.columns]))


_STATIC = with_(**bound("static_0", "static_cb_0"))
_AMOUNTS = (
    "credamount_770A", "annuity_780A", "annuitynextmonth_57A", "currdebt_22A", "disbursedcredamount_1113A",
    "downpmt_116A", "maxannuity_159A", "lastapprcredamount_781A", "lastrejectcredamount_222A",
)


def _nulls(cols):
    return "CAST(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in cols) + " AS INTEGER)"


@query(
    "derived_missing",
    f"{_STATIC} SELECT case_id, {_nulls((*_AMOUNTS, 'applicationcnt_361L', 'firstclxcampaign_1125D', 'numberofqueries_373L', 'pmtssum_45A', 'responsedate_1012D', 'education_88M'))}"
    f" AS derived__null_count, {_nulls((*_AMOUNTS, 'pmtssum_45A'))} AS derived__amount_null_count"
    " FROM static_0 JOIN static_cb_0 USING (case_id)",
)
def q_missing(spark, sf):
    wide = frame(spark, sf, "static_0").join(frame(spark, sf, "static_cb_0"), "case_id")
    return _new(spark, sf, wide, "missing")


_LINES = "SELECT l_orderkey AS case_id, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1"


@query(
    "derived_counts",
    f"WITH c AS ({_LINES}) SELECT case_id, CASE WHEN n > 0 THEN 1 ELSE 0 END AS applprev_1__row_count__has_record,"
    f" {R('ln(1 + n)')} AS applprev_1__row_count__log1p FROM c",
)
def q_counts(spark, sf):
    n = frame(spark, sf, "applprev_1").groupBy("case_id").agg(F.count(F.lit(1)).alias("applprev_1__row_count"))
    return _new(spark, sf, n, "counts")


_BUREAU = "credit_bureau_a_1"
_TOP = ("overdueamount_31A", "outstandingamount_354A", "dpdmax_139P", "dpdmax_757P", "overdueamountmax_155A",
        "totaloutstanddebtvalue_39A", "credlmt_230A", "totalamount_6A", "nominalrate_281L", "numberofinstls_229L",
        "numberofoverdueinstlmax_1039L")
_BUREAU_CTE = (
    f"b AS (SELECT g.case_id, {', '.join(f'max({c}) AS {c}__max, min({c}) AS {c}__min' for c in _TOP)},"
    " CAST(max(z.date_decision - dateofcredstart_181D) AS DOUBLE) AS start__max,"
    " CAST(min(z.date_decision - dateofcredstart_181D) AS DOUBLE) AS start__min,"
    " CAST(max(z.date_decision - lastupdate_388D) AS DOUBLE) AS update__max,"
    " CAST(min(z.date_decision - lastupdate_388D) AS DOUBLE) AS update__min"
    f" FROM ({bound_sql(_BUREAU)}) g LEFT JOIN ({bound_sql('base')}) z USING (case_id) GROUP BY g.case_id)"
)
_PREV_CTE = (
    "p AS (SELECT case_id, avg(annuity_853A) AS annuity_mean, max(annuity_853A) AS annuity_max, avg(credamount_590A) AS credit_mean,"
    " max(credamount_590A) AS credit_max, max(currdebt_94A) AS debt_max, max(downpmt_134A) AS down_max,"
    " max(actualdpd_943P) AS dpd_max, max(maxdpdtolerance_577P) AS tol_max, min(maxdpdtolerance_577P) AS tol_min, count(*) AS n"
    f" FROM ({bound_sql('applprev_1')}) GROUP BY 1)"
)


def _joined(spark, sf, *groups):
    """Static columns with listed-policy aggregates of the groups."""
    src = source(spark, sf)
    wide = normalize_dates(frame(spark, sf, "static_0"))
    decisions = decision_dates(load_base(src))
    for g in groups:
        wide = wide.join(aggregate_group(src, g, "ex2_data", decisions=decisions), "case_id", "left")
    return wide


@query(
    "derived_ratios",
    _select(
        {
            "derived__annuity_to_credamount": _ratio("annuity_780A", "credamount_770A"),
            "derived__next_annuity_to_annuity": _ratio("annuitynextmonth_57A", "annuity_780A"),
            "derived__currdebt_to_credamount": _ratio("currdebt_22A", "credamount_770A"),
            "derived__disbursed_to_credamount": _ratio("disbursedcredamount_1113A", "credamount_770A"),
            "derived__downpmt_to_credamount": _ratio("downpmt_116A", "credamount_770A"),
            "derived__maxannuity_to_annuity": _ratio("maxannuity_159A", "annuity_780A"),
            "derived__lastappr_to_credamount": _ratio("lastapprcredamount_781A", "credamount_770A"),
            "derived__lastreject_to_credamount": _ratio("lastrejectcredamount_222A", "credamount_770A"),
            "derived__bureau_overdue_to_outstanding_max": _ratio("overdueamount_31A__max", "outstandingamount_354A__max"),
            "derived__prev_annuity_mean_to_current": _ratio("annuity_mean", "annuity_780A"),
            "derived__prev_credamount_mean_to_current": _ratio("credit_mean", "credamount_770A"),
        },
        "static_0 LEFT JOIN b USING (case_id) LEFT JOIN p USING (case_id)",
        f"{_STATIC}, {_BUREAU_CTE}, {_PREV_CTE}",
    ),
)
def q_ratios(spark, sf):
    return _new(spark, sf, _joined(spark, sf, _BUREAU, "applprev_1"), "ratios")


@query(
    "derived_ranges_stable",
    _select(
        {
            f"{_BUREAU}__lastupdate_388D__range": "update__max - update__min",
            f"{_BUREAU}__dpdmax_757P__range": "dpdmax_757P__max - dpdmax_757P__min",
            f"{_BUREAU}__dateofcredstart_181D__range": "start__max - start__min",
            f"{_BUREAU}__totalamount_6A__range": "totalamount_6A__max - totalamount_6A__min",
            f"{_BUREAU}__numberofinstls_229L__range": "numberofinstls_229L__max - numberofinstls_229L__min",
            f"{_BUREAU}__dpdmax_139P__range": "dpdmax_139P__max - dpdmax_139P__min",
            f"{_BUREAU}__overdueamountmax_155A__range": "overdueamountmax_155A__max - overdueamountmax_155A__min",
            f"{_BUREAU}__numberofoverdueinstlmax_1039L__range": "numberofoverdueinstlmax_1039L__max - numberofoverdueinstlmax_1039L__min",
            "applprev_1__maxdpdtolerance_577P__range": "tol_max - tol_min",
        },
        "b JOIN p USING (case_id)",
        f"WITH {_BUREAU_CTE}, {_PREV_CTE}",
    ),
)
def q_ranges_stable(spark, sf):
    src = source(spark, sf)
    decisions = decision_dates(load_base(src))
    parts = [aggregate_group(src, g, "ex2_data", decisions=decisions) for g in (_BUREAU, "applprev_1")]
    return _new(spark, sf, parts[0].join(parts[1], "case_id"), "ranges_stable")


_FREE = ("dpdmax_139P", "dpdmax_757P", "overdueamountmax_155A", "overdueamount_31A", "outstandingamount_354A",
         "totaloutstanddebtvalue_39A", "credlmt_230A", "totalamount_6A", "nominalrate_281L", "numberofinstls_229L",
         "numberofoverdueinstlmax_1039L")


@query(
    "derived_ranges",
    _select(
        {
            **{f"{_BUREAU}__{c}__range": f"{c}__max - {c}__min" for c in _FREE},
            f"{_BUREAU}__dateofcredstart_181D__range": "start__max - start__min",
            f"{_BUREAU}__lastupdate_388D__range": "update__max - update__min",
            f"{_BUREAU}__refreshdate_3813885D__range": "start__max - start__min",
            f"{_BUREAU}__contractst_545M__range": "NULL",
        },
        "b",
        f"WITH {_BUREAU_CTE}",
    ),
)
def q_ranges(spark, sf):
    """Every column of this table qualifies: its name contains a money word."""
    src = source(spark, sf)
    wide = aggregate_group(src, _BUREAU, "ex2_data", decisions=decision_dates(load_base(src)))
    return _new(spark, sf, wide, "ranges")


# --- payment-level groups on the customer binding ---------------------------------------------

_CASES = f"{_P}, {_CONTRACT_CTE}, k AS (SELECT case_id, {', '.join([*_CASE, *_CASE_STATS])} FROM c GROUP BY case_id)"


def _k(name):
    return f'CAST("{G}__{name}" AS DOUBLE)'


def _payments(spark, sf, feature_set):
    return _new(spark, sf, aggregate_two_stage(frame(spark, sf, G, "customers"), G), feature_set)


@query(
    "derived_delinquency",
    _select(
        {
            "derived__a2_overdue_contract_rate": _ratio(_k("overdue_contract_count"), _k("contract_count")),
            "derived__a2_payment_per_contract": _ratio(_k("payment_count"), _k("contract_count")),
            **{
                f"derived__a2_dpd_gt{n}_contract_rate": _ratio(_k(f"has_dpd_gt{n}"), _k("contract_count")) for n in (30, 60, 90)
            },
            **{
                f"derived__a2_dpd_gt{n}_payment_rate": _ratio(_k(f"dpd_gt{n}_payment_count"), _k("payment_count"))
                for n in (0, 30, 60, 90)
            },
            "derived__a2_overdue_amt_gt0_payment_rate": _ratio(_k("overdue_amt_gt0_payment_count"), _k("payment_count")),
        },
        "k",
        _CASES,
    ),
)
def q_delinquency(spark, sf):
    return _payments(spark, sf, "a2_delinquency")


def _mix():
    out = {}
    for s in ("active", "closed"):
        out[f"derived__a2_{s}_payment_share"] = _ratio(_k(f"{s}_payment_count"), _k("payment_count"))
        out[f"derived__a2_{s}_contract_rate"] = _ratio(_k(f"has_{s}_payment"), _k("contract_count"))
        for kind in ("dpd_gt30", "overdue_amt_gt0"):
            out[f"derived__a2_{s}_{kind}_payment_rate"] = _ratio(_k(f"{s}_{kind}_payment_count"), _k(f"{s}_payment_count"))
    for kind, short in (("dpd_gt30", "dpd_gt30_rate"), ("overdue_amt_gt0", "overdue_amt_rate")):
        a, c = (_div(_k(f"{s}_{kind}_payment_count"), _k(f"{s}_payment_count")) for s in ("active", "closed"))
        out[f"derived__a2_active_minus_closed_{short}"] = f"coalesce({a}, 0) - coalesce({c}, 0)"
    return out


@query("derived_payment_mix", _select(_mix(), "k", _CASES))
def q_mix(spark, sf):
    return _payments(spark, sf, "a2_payment_mix")


@query(
    "derived_temporal",
    _select(
        {
            **{f"derived__a2_{s}_period_span_ratio": _ratio(_k(f"{s}_period_span"), _k(f"{s}_period_max")) for s in ("active", "closed")},
            **{
                f"derived__a2_{s}_bad_latest_period_gap": f"{_k(f'{s}_period_max')} - {_k(f'{s}_dpd_gt30_period_max')}"
                for s in ("active", "closed")
            },
            "derived__a2_active_closed_latest_period_delta": f"{_k('active_period_max')} - {_k('closed_period_max')}",
        },
        "k",
        _CASES,
    ),
)
def q_temporal(spark, sf):
    return _payments(spark, sf, "a2_temporal")


_PERSON_CTE = (
    "q AS (SELECT g.case_id, max(mainoccupationinc_384A) AS income,"
    " CAST(first(z.date_decision - birth_259D ORDER BY num_group1) AS DOUBLE) AS age,"
    " TRY_CAST(first(empl_employedtotal_800L ORDER BY num_group1) AS DOUBLE) AS worked"
    f" FROM ({bound_sql('person_1')}) g LEFT JOIN ({bound_sql('base')}) z USING (case_id) GROUP BY g.case_id)"
)


@query(
    "derived_semantic_person",
    _select(
        {
            "derived__person_age_years": "age / 365.25",
            "derived__income_to_credamount": _ratio("income", "credamount_770A"),
            "derived__annuity_to_income": _ratio("annuity_780A", "income"),
            "derived__currdebt_to_income": _ratio("currdebt_22A", "income"),
            "derived__employment_age_ratio": _div("worked", "age"),
        },
        "static_0 LEFT JOIN q USING (case_id)",
        f"{_STATIC}, {_PERSON_CTE}",
    ),
)
def q_person(spark, sf):
    return _new(spark, sf, _joined(spark, sf, "person_1"), "semantic_v2")


_OVERDUE = "greatest(overdueamountmax_155A__max, overdueamount_31A__max)"
_OUT = "greatest(outstandingamount_354A__max, totaloutstanddebtvalue_39A__max)"


@query(
    "derived_semantic_bureau",
    _select(
        {
            "derived__bureau_a1_max_dpd": "greatest(dpdmax_139P__max, dpdmax_757P__max)",
            "derived__bureau_a1_overdue_instl_max": "numberofoverdueinstlmax_1039L__max",
            "derived__bureau_a1_overdue_amount_max": _OVERDUE,
            "derived__bureau_a1_overdue_to_outstanding": _div(_OVERDUE, _OUT),
            "derived__bureau_a1_outstanding_debt_max": _OUT,
            "derived__bureau_a1_debt_to_credit_limit": _div(_OUT, "credlmt_230A__max"),
            "derived__bureau_a1_outstanding_to_total_amount": _div(_OUT, "totalamount_6A__max"),
            "derived__bureau_a1_recent_update_gap": "update__min",
            "derived__bureau_a1_credit_age_span": "start__max - start__min",
        },
        "b",
        f"WITH {_BUREAU_CTE}",
    ).replace(
        " FROM b", f", CASE WHEN coalesce({_OVERDUE}, 0) > 0 THEN 1 ELSE 0 END AS derived__bureau_a1_any_overdue_amount FROM b"
    ),
)
def q_bureau(spark, sf):
    src = source(spark, sf)
    wide = aggregate_group(src, _BUREAU, "ex2_data", decisions=decision_dates(load_base(src)))
    return _new(spark, sf, wide, "semantic_v2")


@query(
    "derived_semantic_previous",
    _select(
        {
            "derived__prev_credit_mean_to_current": _ratio("credit_mean", "credamount_770A"),
            "derived__prev_credit_max_to_current": _ratio("credit_max", "credamount_770A"),
            "derived__prev_annuity_max_to_current": _ratio("annuity_max", "annuity_780A"),
            "derived__prev_debt_max_to_credit_max": _ratio("debt_max", "credit_max"),
            "derived__prev_downpmt_max_to_credit_max": _ratio("down_max", "credit_max"),
            "derived__prev_max_dpd": "greatest(dpd_max, tol_max)",
            "derived__prev_dpd_per_application": _div("tol_max", "n"),
        },
        "static_0 LEFT JOIN p USING (case_id)",
        f"{_STATIC}, {_PREV_CTE}",
    ),
)
def q_previous(spark, sf):
    return _new(spark, sf, _joined(spark, sf, "applprev_1"), "semantic_v2")


_OWED_A, _OWED_C = _k("pmts_overdue_1140A__sum"), _k("pmts_overdue_1152A__sum")


@query(
    "derived_semantic_payments",
    _select(
        {
            "derived__a2_max_dpd": f"greatest({_k('pmts_dpd_1073P__max')}, {_k('pmts_dpd_303P__max')})",
            "derived__a2_active_closed_max_dpd_delta": f"{_k('pmts_dpd_1073P__max')} - {_k('pmts_dpd_303P__max')}",
            "derived__a2_dpd30_to_dpd0_rate": _ratio(_k("dpd_gt30_payment_count"), _k("dpd_gt0_payment_count")),
            "derived__a2_dpd90_to_dpd30_rate": _ratio(_k("dpd_gt90_payment_count"), _k("dpd_gt30_payment_count")),
            "derived__a2_active_overdue_amount_per_payment": _ratio(_OWED_A, _k("payment_count")),
            "derived__a2_overdue_amount_per_payment": _div(f"({_OWED_A} + {_OWED_C})", _k("payment_count")),
            "derived__a2_closed_overdue_amount_per_payment": _ratio(_OWED_C, _k("payment_count")),
        },
        "k",
        _CASES,
    ),
)
def q_payments(spark, sf):
    return _payments(spark, sf, "semantic_v2")
