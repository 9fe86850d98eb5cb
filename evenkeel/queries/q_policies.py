"""Aggregation primitives, policies, group orchestration and the full build."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.functions import aggregates as A
from evenkeel.functions.aggregates import Measure
from evenkeel.functions.scalar import normalize_dates, to_double
from evenkeel.operators import policies as P
from evenkeel.operators.encode import pairwise_correlations
from evenkeel.operators.grouping import aggregate_by_key
from evenkeel.operators.hierarchy import aggregate_large_lite
from evenkeel.operators.profile import null_profile_by_file
from evenkeel.plans.wide import aggregate_group, aggregate_large, build_features, decision_dates, row_order
from evenkeel.queries.bindings import by_case, frame, read, source
from evenkeel.queries.registry import TIE_SHIFT, R, agg_sql, bound, group_sql, query, rounded, with_
from evenkeel.sources.tables import load_base

PREV = "applprev_1"


def _one(name: str, op: str, col: str, mode: str = "number", fill: float | None = None, group: str = PREV):
    """A query for one aggregate of one column per case."""
    out = f"{col}__{op}"
    sql = group_sql(group, [agg_sql(out, op, col, mode, fill=fill is not None)])

    @query(name, sql)
    def run(spark, sf):
        df = normalize_dates(frame(spark, sf, group))
        measure = Measure(out, op, col if op != "row_count" else None, mode, fill)
        return rounded(aggregate_by_key(df, "case_id", [measure], ("num_group1",)))


for _name, _op, _col, _mode, _fill in (
    ("agg_mean", "mean", "annuity_853A", "number", None),
    ("agg_max", "max", "annuity_853A", "number", None),
    ("agg_min", "min", "actualdpd_943P", "number", None),
    ("agg_std", "std", "annuity_853A", "number", None),
    ("agg_sum", "sum", "currdebt_94A", "number", None),
    ("agg_median", "median", "annuity_853A", "number", None),
    ("agg_first", "first", "annuity_853A", "number", None),
    ("agg_last", "last", "cancelreason_3545846M", "raw", None),
    ("agg_nunique", "nunique", "cancelreason_3545846M", "raw", None),
    ("agg_count_nonnull", "count", "actualdpd_943P", "raw", None),
    ("agg_var", "var", "pmtnum_254L", "number", None),
    ("agg_string_max", "max", "cancelreason_3545846M", "raw", None),
    ("agg_max_minus_min_lambda", "gap", "currdebt_94A", "number", 0.0),
):
    _one(_name, _op, _col, _mode, _fill)

_one("agg_row_count", "row_count", "all")


@query(
    "agg_range",
    group_sql(
        PREV,
        [agg_sql("annuity__gap", "gap", "annuity_853A"), agg_sql("annuity__gap_filled", "gap", "annuity_853A", fill=True)],
    ),
)
def agg_range(spark, sf):
    measures = [
        Measure("annuity__gap", "gap", "annuity_853A"),
        Measure("annuity__gap_filled", "gap", "annuity_853A", fill=0.0),
    ]
    return rounded(aggregate_by_key(frame(spark, sf, PREV), "case_id", measures))


@query(
    "agg_filtered_max",
    group_sql(
        "person_1",
        [agg_sql("income_selfemployed", "max", "mainoccupationinc_384A", where="incometype_1044T = 'SELFEMPLOYED'")],
    ),
)
def agg_filtered_max(spark, sf):
    df = frame(spark, sf, "person_1")
    only = (fixed.PERSON_INCOME_TYPE, fixed.SELF_EMPLOYED)
    return rounded(
        aggregate_by_key(df, "case_id", [Measure("income_selfemployed", "max", fixed.PERSON_INCOME, only=only)])
    )


PAYMENTS = "credit_bureau_a_2"
_ACTIVE = fixed.PAYMENT_SIDES["active"]


@query(
    "agg_conditional_period_max",
    group_sql(
        PAYMENTS,
        [
            "CAST(max(CASE WHEN coalesce(pmts_dpd_1073P, 0) > 30 THEN pmts_year_1139T * 12 + pmts_month_158T END)"
            " AS BIGINT) AS bad_period"
        ],
    ),
)
def agg_conditional_period_max(spark, sf):
    period = F.col(_ACTIVE["year"]) * 12 + F.col(_ACTIVE["month"])
    bad = F.coalesce(F.col(_ACTIVE["dpd"]), F.lit(0.0)) > 30
    return frame(spark, sf, PAYMENTS).groupBy("case_id").agg(
        A.filtered_max(period, bad).cast("long").alias("bad_period")
    )


@query(
    "agg_any_flag",
    group_sql(
        PAYMENTS,
        [
            "max(CASE WHEN coalesce(pmts_dpd_1073P, 0) > 60 OR coalesce(pmts_overdue_1152A, 0) > 2000 THEN 1 ELSE 0 END)"
            " AS any_bad"
        ],
    ),
)
def agg_any_flag(spark, sf):
    late = F.coalesce(F.col("pmts_dpd_1073P"), F.lit(0.0)) > 60
    owed = F.coalesce(F.col("pmts_overdue_1152A"), F.lit(0.0)) > 2000
    return frame(spark, sf, PAYMENTS).groupBy("case_id").agg(A.any_flag([late, owed]).alias("any_bad"))


@query(
    "agg_threshold_count",
    group_sql(
        PAYMENTS,
        [
            f"CAST(sum(CASE WHEN coalesce(pmts_dpd_1073P, 0) > {n} THEN 1 ELSE 0 END"
            f" + CASE WHEN coalesce(pmts_dpd_303P, 0) > {n} THEN 1 ELSE 0 END) AS BIGINT) AS above_{n}"
            for n in (0, 30, 60, 90)
        ],
    ),
)
def agg_threshold_count(spark, sf):
    dpd = [to_double("pmts_dpd_1073P"), to_double("pmts_dpd_303P")]
    return frame(spark, sf, PAYMENTS).groupBy("case_id").agg(
        *[A.threshold_count(dpd, n).alias(f"above_{n}") for n in fixed.DPD_LIMITS]
    )


_NULL_COLUMNS = ("pmts_dpd_1073P", "pmts_overdue_1152A", "pmts_year_507T")


@query(
    "agg_null_profile",
    with_(**bound(PAYMENTS))
    + " "
    + " UNION ALL ".join(
        f"SELECT CASE WHEN num_group1 > 3 THEN 'late' ELSE 'early' END AS file, '{c}' AS feature,"
        f" CAST(count(*) AS BIGINT) AS rows, {R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate,"
        f" {R(f'CAST(min({c}) AS DOUBLE)')} AS min, {R(f'CAST(max({c}) AS DOUBLE)')} AS max,"
        f" {R(f'avg({c})')} AS mean FROM {PAYMENTS} GROUP BY 1"
        for c in _NULL_COLUMNS
    ),
)
def agg_null_profile(spark, sf):
    part = F.when(F.col("num_group1") > 3, "late").otherwise("early")
    df = frame(spark, sf, PAYMENTS).withColumn("file", part)
    return rounded(null_profile_by_file(df, _NULL_COLUMNS))


@query(
    "agg_population_std",
    f"SELECT o_orderpriority, {R('stddev_pop(o_totalprice)')} AS spread FROM orders GROUP BY 1",
)
def agg_population_std(spark, sf):
    return rounded(
        read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.stddev_pop("o_totalprice").alias("spread"))
    )


@query("group_distinct_keys", group_sql("credit_bureau_b_1", ["1 AS one"]).replace(", 1 AS one", ""))
def group_distinct_keys(spark, sf):
    return aggregate_by_key(frame(spark, sf, "credit_bureau_b_1"), "case_id", [])


@query(
    "global_min_max",
    with_(**bound("base")) + " SELECT min(WEEK_NUM) AS lo, max(WEEK_NUM) AS hi FROM base",
)
def global_min_max(spark, sf):
    return frame(spark, sf, "base").agg(F.min("WEEK_NUM").alias("lo"), F.max("WEEK_NUM").alias("hi"))


@query(
    "min_by_key",
    with_(**bound("credit_bureau_a_1"))
    + " SELECT case_id, min(refreshdate_3813885D) AS first_refresh FROM credit_bureau_a_1 GROUP BY 1",
)
def min_by_key(spark, sf):
    df = normalize_dates(frame(spark, sf, "credit_bureau_a_1"))
    return df.groupBy("case_id").agg(F.min(fixed.REFRESH_DATE).alias("first_refresh"))


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS left_col, '{b}' AS right_col, {R(f'corr({a}, {b})')} AS corr FROM lineitem" for a, b in _PAIRS
    ),
)
def corr_matrix(spark, sf):
    found = pairwise_correlations(read(spark, sf, "lineitem"), _PAIRS)
    rows = [(a, b, v) for (a, b), v in found.items()]
    return rounded(spark.createDataFrame(rows, "left_col string, right_col string, corr double"))


# --- policies -------------------------------------------------------------------------------


def _run(group, measures, dated=False):
    def run(spark, sf):
        src = source(spark, sf)
        df = normalize_dates(src.table(group))
        decisions = decision_dates(load_base(src)) if dated else None
        return rounded(
            aggregate_by_key(df, "case_id", measures(df.schema), row_order(df, src.naming), decisions)
        )

    return run


def _cells(group, table, style="suffix", order="num_group1", mode="number"):
    """Check cells from {column: (ops, mode)}."""
    out = []
    for col, spec in table.items():
        ops, m = spec if isinstance(spec[0], (tuple, list)) else (spec, mode)
        for op in ops:
            name = f"{group}__{col}__{op}" if style == "suffix" else f"{op}_{col}"
            out.append(agg_sql(name, op, col, m, order))
    return out


def _count(group):
    return agg_sql(f"{group}__row_count", "row_count", "")


_4 = ("mean", "max", "min", "std")
_DEFAULT = {
    "annuity_853A": _4, "credamount_590A": _4, "currdebt_94A": _4, "downpmt_134A": _4, "actualdpd_943P": _4,
    "maxdpdtolerance_577P": _4, "pmtnum_254L": _4, "interestrate_311T": _4, "creationdate_885D": _4,
    "isbidproduct_390L": _4, "cancelreason_3545846M": (("nunique",), "raw"),
}
query("agg_policy_default", group_sql(PREV, [_count(PREV), *_cells(PREV, _DEFAULT)]))(
    _run(PREV, lambda s: P.default_policy(PREV, s))
)

_6 = ("max", "min", "mean", "std", "sum", "median")
_CUSTOM = {
    "annuity_853A": _6, "credamount_590A": _6, "currdebt_94A": _6, "actualdpd_943P": _6, "pmtnum_254L": _6,
    "interestrate_311T": ("max", "min"), "isbidproduct_390L": ("max", "last"),
}


def _custom_numeric(schema):
    return [
        m for c in _CUSTOM for m in P.ask(c, P.custom_numeric_ops(PREV, c, schema[c].dataType), f"{PREV}__{c}")
    ]


query("agg_policy_custom_numeric", group_sql(PREV, _cells(PREV, _CUSTOM)))(_run(PREV, _custom_numeric))

_TEXT = {
    "cacccardblochreas_147M": (("first", "last", "nunique"), "raw"),
    "conts_type_509L": (("first", "last", "nunique"), "raw"),
    "credacc_cards_status_52L": (("first", "last", "nunique"), "raw"),
}
_INNER_ORDER = "num_group1, num_group2"
query(
    "agg_policy_custom_categorical",
    group_sql("applprev_2", _cells("applprev_2", _TEXT, order=_INNER_ORDER)),
)(
    _run(
        "applprev_2",
        lambda s: [m for c in _TEXT for m in P.ask(c, P.custom_text_ops("applprev_2"), f"applprev_2__{c}", "raw")],
    )
)

_TAX = "tax_registry_a_1"
_TAX_OPS = ("max", "min", "first", "last", "mean", "std")
query(
    "agg_policy_custom_apply",
    group_sql(
        _TAX,
        [
            _count(_TAX),
            *_cells(
                _TAX,
                {
                    "amount_4527230A": (*_TAX_OPS, "gap"),
                    "recorddate_4527225D": ((*_TAX_OPS, "gap"), "before"),
                    "name_4527232M": (("first", "last", "nunique"), "raw"),
                },
            ),
        ],
        dated=True,
    ),
)(_run(_TAX, lambda s: P.custom_policy(_TAX, s, frozenset({"table_custom_aggs"})), dated=True))

# All table-specific lists of the listed policy in one wide result.
_BUREAU = "credit_bureau_a_1"
_MM = ("max", "min")
_5 = ("mean", "std", "sum", "median", "first")
_BUREAU_TYPED = [
    "dpdmax_139P", "dpdmax_757P", "overdueamountmax_155A", "overdueamount_31A", "outstandingamount_354A",
    "totaloutstanddebtvalue_39A", "credlmt_230A", "totalamount_6A", "nominalrate_281L", "numberofinstls_229L",
    "numberofoverdueinstlmax_1039L",
]
_BUREAU_EXTRA = ["credlmt_230A", "nominalrate_281L", "numberofinstls_229L", "numberofoverdueinstlmax_1039L"]
_BUREAU_DATES = ["dateofcredstart_181D", "lastupdate_388D", "refreshdate_3813885D"]
_PERSON_SQL = [
    _count("person_1"),
    *_cells(
        "person_1",
        {
            **{c: (("first",), "before") for c in ("empl_employedfrom_271D", "birth_259D")},
            **{
                c: (("first",), "raw")
                for c in (
                    "empl_employedtotal_800L", "empl_industry_691L", "familystate_447L", "incometype_1044T", "sex_738L",
                    "housetype_905L", "isreference_387L",
                )
            },
            "mainoccupationinc_384A": ("max",),
        },
    ),
    agg_sql(
        "person_1__mainoccupationinc_384A__selfemployed_max", "max", "mainoccupationinc_384A",
        where="incometype_1044T = 'SELFEMPLOYED'",
    ),
]
_EX2 = {
    "person_1": _PERSON_SQL,
    _BUREAU: [
        _count(_BUREAU),
        *_cells(_BUREAU, {c: _MM for c in _BUREAU_TYPED}),
        *_cells(_BUREAU, {c: (_MM, "before") for c in _BUREAU_DATES}),
        agg_sql(f"{_BUREAU}__contractst_545M__max", "max", "contractst_545M"),
        agg_sql(f"{_BUREAU}__contractst_545M__min", "min", "contractst_545M"),
        *_cells(_BUREAU, {c: _5 for c in _BUREAU_EXTRA}),
    ],
    "deposit_1": [
        _count("deposit_1"),
        *_cells("deposit_1", {"amount_416A": _MM, "openingdate_313D": (_MM, "before")}),
    ],
    "other_1": [
        _count("other_1"),
        *_cells(
            "other_1",
            {
                "amtdepositbalance_4809441A": ("first",), "amtdebitincoming_4809443A": ("first",),
                "status_1M": (("first",), "raw"),
            },
        ),
    ],
}


def _join_sql(parts: dict[str, str]) -> str:
    """Case-wise join of several grouped checks."""
    names = list(parts)
    text = f"SELECT * FROM ({parts[names[0]]}) {names[0]}_q"
    for n in names[1:]:
        text += f" JOIN ({parts[n]}) {n}_q USING (case_id)"
    return text


@query("agg_policy_ex2", _join_sql({g: group_sql(g, cells, dated=True) for g, cells in _EX2.items()}))
def agg_policy_ex2(spark, sf):
    def joined(src, hot_rows):
        decisions = decision_dates(load_base(src))
        out = None
        for g in _EX2:
            part = aggregate_group(src, g, "ex2_data", decisions=decisions, hot_rows=hot_rows)
            out = part if out is None else out.join(part, "case_id")
        return out

    return rounded(by_case(spark, sf, joined))


_GENERAL = "tax_registry_b_1"
query(
    "agg_policy_ex2_general",
    group_sql(
        _GENERAL,
        _cells(
            _GENERAL,
            {"amount_4917619A": ("max", "min", "mean", "std", "sum", "median"), "deductiondate_4917603D": (_MM, "before")},
        ),
        dated=True,
    ),
)(_run(_GENERAL, lambda s: P.listed_general(_GENERAL, s), dated=True))

_SUFFIX_ALL = [
    "annuity_853A", "credamount_590A", "currdebt_94A", "downpmt_134A", "actualdpd_943P", "maxdpdtolerance_577P",
    "pmtnum_254L", "interestrate_311T", "creationdate_885D", "cancelreason_3545846M", "isbidproduct_390L",
]
_SUFFIX_LA = ["annuity_853A", "credamount_590A", "currdebt_94A", "downpmt_134A", "pmtnum_254L", "isbidproduct_390L"]
query(
    "agg_policy_suffix_num",
    group_sql(
        PREV,
        [
            *_cells(PREV, {c: _MM for c in _SUFFIX_ALL}, "prefix"),
            *_cells(PREV, {c: ("mean", "std", "sum", "median") for c in _SUFFIX_LA}, "prefix"),
        ],
    ),
)(_run(PREV, P.suffix_numeric_policy))

_LGB = {
    "person_1": [
        *_cells(
            "person_1",
            {
                c: (("first",), "raw")
                for c in (
                    "empl_employedtotal_800L", "empl_employedfrom_271D", "empl_industry_691L", "familystate_447L",
                    "incometype_1044T", "sex_738L", "housetype_905L", "isreference_387L", "birth_259D",
                )
            },
            "prefix",
        ),
        agg_sql("mainoccupationinc_384A_max", "max", "mainoccupationinc_384A"),
        agg_sql(
            "mainoccupationinc_384A_any_selfemployed", "max", "mainoccupationinc_384A",
            where="incometype_1044T = 'SELFEMPLOYED'",
        ),
    ],
    _TAX: [
        *_cells(_TAX, {c: _TAX_OPS for c in ("amount_4527230A", "recorddate_4527225D", "name_4527232M")}, "prefix"),
        agg_sql("max-min_gap_depth2_amount_4527230A", "gap", "amount_4527230A", fill=True),
    ],
    "other_1": [
        agg_sql("__other_amtdepositbalance_4809441A", "first", "amtdepositbalance_4809441A"),
        agg_sql("__other_amtdebitincoming_4809443A", "first", "amtdebitincoming_4809443A"),
        agg_sql("__other_status_1M", "first", "status_1M", "raw"),
    ],
    "person_2": _cells(
        "person_2",
        {
            c: (("first", "last"), "raw")
            for c in ("empls_economicalst_849M", "empls_employedfrom_796D", "empls_employer_name_740M")
        },
        "prefix",
        _INNER_ORDER,
    ),
}


@query("agg_policy_lgb644", _join_sql({g: group_sql(g, cells) for g, cells in _LGB.items()}))
def agg_policy_lgb644(spark, sf):
    src = source(spark, sf)
    out = None
    for g in _LGB:
        part = aggregate_group(src, g, "sota_lgb_644")
        out = part if out is None else out.join(part, "case_id")
    return rounded(out)


_PAY_TYPED = [
    "pmts_dpd_1073P", "pmts_dpd_303P", "pmts_overdue_1140A", "pmts_overdue_1152A", "pmts_month_158T",
    "pmts_month_706T", "pmts_year_1139T", "pmts_year_507T", "collater_valueofguarantee_1124L",
    "collater_typofvalofguarant_298M",
]
_LARGE_CELLS = [
    *[agg_sql(f"{op}_depth2_{c}", op, c) for c in _PAY_TYPED for op in ("max", "min", "mean")],
    *[agg_sql(f"std_{c}", "std", c) for c in _PAY_TYPED],
    *[
        agg_sql(f"max-min_gap_depth2_{c}", "gap", c, fill=True)
        for c in ("collater_valueofguarantee_1124L", "pmts_dpd_1073P", "pmts_overdue_1140A")
    ],
    agg_sql("count_depth2_a2_num_group2", "count", "num_group2"),
]
query("agg_policy_lgb644_large", group_sql(PAYMENTS, _LARGE_CELLS))(
    lambda spark, sf: rounded(aggregate_large(source(spark, sf), PAYMENTS, "sota_lgb_644"))
)

_PA = ("max", "min", "mean", "std")
_TL = ("max", "min", "sum")
_CAT = {
    "pmts_dpd_1073P": _PA, "pmts_dpd_303P": _PA, "pmts_overdue_1140A": _PA, "pmts_overdue_1152A": _PA,
    "pmts_month_158T": _TL, "pmts_month_706T": _TL, "pmts_year_1139T": _TL, "pmts_year_507T": _TL,
    "collater_valueofguarantee_1124L": _TL,
    "collater_typofvalofguarant_298M": (("last", "nunique", "first"), "raw"),
    "num_group1": ("max",), "num_group2": ("max",),
}
_CAT_SQL = group_sql(PAYMENTS, _cells(PAYMENTS, _CAT, order=_INNER_ORDER))
query("agg_policy_cat661", _CAT_SQL)(_run(PAYMENTS, lambda s: P.by_suffix_policy(PAYMENTS, s)))
# The large-group form: one aggregation over all files, so a case spread over files is whole.
query("agg_large_per_file_unique", _CAT_SQL)(
    lambda spark, sf: rounded(aggregate_large(source(spark, sf), PAYMENTS, "sota_cat_661"))
)

_LITE_CELLS = [
    _count(PAYMENTS),
    *_cells(PAYMENTS, {c: ("mean", "max", "min") for c in fixed.LARGE_COLUMNS[PAYMENTS]}),
]
query("agg_large_lite", group_sql(PAYMENTS, _LITE_CELLS))(
    lambda spark, sf: rounded(aggregate_large_lite(frame(spark, sf, PAYMENTS), PAYMENTS))
)

_EXAMPLE = {
    **{c: ("max", "last", "mean", "var") for c in ("annuity_853A", "credamount_590A", "currdebt_94A", "downpmt_134A", "actualdpd_943P", "maxdpdtolerance_577P")},
    "creationdate_885D": ("max", "last", "mean"),
    "cancelreason_3545846M": (("max", "last"), "raw"),
    "pmtnum_254L": ("max", "last"),
    "interestrate_311T": ("max", "last"),
    "isbidproduct_390L": (("max", "last"), "raw"),
    "num_group1": (("max", "last"), "raw"),
}
# Variances of amounts are in the billions, where later digits are noise.
_EXAMPLE_CELLS = [
    agg_sql(f"{op}_{c}", op, c, mode, digits=0 if op == "var" else 4)
    for c, spec in _EXAMPLE.items()
    for ops, mode in [spec if isinstance(spec[0], tuple) else (spec, "number")]
    for op in ops
]


@query("agg_policy_example", group_sql(PREV, _EXAMPLE_CELLS))
def agg_policy_example(spark, sf):
    df = normalize_dates(frame(spark, sf, PREV))
    out = aggregate_by_key(df, "case_id", P.example_policy(df.schema), row_order(df, source(spark, sf).naming))
    coarse = {c: F.round(F.col(c) + F.lit(float(TIE_SHIFT)), 0) for c in out.columns if c.startswith("var_")}
    return rounded(out.withColumns(coarse))


query(
    "aggregate_group",
    group_sql(
        "credit_bureau_b_1",
        [
            _count("credit_bureau_b_1"),
            *_cells(
                "credit_bureau_b_1",
                {
                    "amount_1115A": ("max", "min", "mean", "std"),
                    "dpd_550P": ("max", "mean", "std"),
                    "contractdate_551D": (("max", "min", "gap"), "before"),
                    "classification_1M": (("nunique",), "raw"),
                },
            ),
        ],
        dated=True,
    ),
)(
    lambda spark, sf: rounded(
        aggregate_group(
            source(spark, sf), "credit_bureau_b_1", "custom_bureau_b_narrow_aggs",
            decisions=decision_dates(load_base(source(spark, sf))),
        )
    )
)


# --- the full build -------------------------------------------------------------------------

_STATIC_SQL = [
    "credamount_770A", "annuity_780A", "annuitynextmonth_57A", "currdebt_22A", "disbursedcredamount_1113A",
    "downpmt_116A", "maxannuity_159A", "lastapprcredamount_781A", "lastrejectcredamount_222A",
]
_BUILD_GROUPS = {
    "person_1": {
        "mainoccupationinc_384A": _4, "childnum_185L": _4, "birth_259D": _4, "empl_employedfrom_271D": _4,
        "empl_employedtotal_800L": (("nunique",), "raw"), "empl_industry_691L": (("nunique",), "raw"),
        "familystate_447L": (("nunique",), "raw"), "incometype_1044T": (("nunique",), "raw"), "sex_738L": (("nunique",), "raw"),
        "housetype_905L": (("nunique",), "raw"), "isreference_387L": _4,
    },
    "applprev_1": _DEFAULT,
    "tax_registry_a_1": {
        "amount_4527230A": _4, "recorddate_4527225D": _4, "name_4527232M": (("nunique",), "raw"),
    },
    _BUREAU: {
        **{c: _4 for c in (*_BUREAU_TYPED, *_BUREAU_DATES)}, "contractst_545M": (("nunique",), "raw"),
    },
}


def _build_sql() -> str:
    ctes = bound("base", "static_0", "static_cb_0")
    for g, table in _BUILD_GROUPS.items():
        cells = ", ".join([_count(g), *_cells(g, table)])
        ctes[g] = f"SELECT case_id, {cells} FROM ({bound(g)[g]}) GROUP BY case_id"
    lite = ", ".join(_LITE_CELLS)
    ctes[PAYMENTS] = f"SELECT case_id, {lite} FROM ({bound(PAYMENTS)[PAYMENTS]}) GROUP BY case_id"
    static = ", ".join(f"{R(c)} AS {c}" for c in [*_STATIC_SQL, "pmtssum_45A"])
    outs = [f'{g}."{g}__row_count"' for g in _BUILD_GROUPS]
    for g, table in _BUILD_GROUPS.items():
        outs += [c.rsplit(" AS ", 1)[1] for c in _cells(g, table)]
    outs += [c.rsplit(" AS ", 1)[1] for c in _LITE_CELLS]
    joins = " ".join(f"LEFT JOIN {t} USING (case_id)" for t in ctes if t != "base")
    return (
        f"{with_(**ctes)} SELECT case_id, date_decision, MONTH, WEEK_NUM, target, applicationcnt_361L,"
        f" firstclxcampaign_1125D, numberofqueries_373L, responsedate_1012D, education_88M, {static}, {', '.join(outs)}"
        f" FROM base {joins}"
    )


_BUILD_SQL = _build_sql()


@query("build_features", _BUILD_SQL)
def build(spark, sf):
    return rounded(by_case(spark, sf, lambda src, hot_rows: build_features(src, "a2core", hot_rows=hot_rows)))
