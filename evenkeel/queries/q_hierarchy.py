"""Payment -> contract -> case, on customers, their orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.operators.hierarchy import aggregate_two_stage, case_column_stats, case_from_contracts, contract_table
from evenkeel.queries.bindings import bound_sql, frame
from evenkeel.queries.registry import R, query, rounded, with_

G = "credit_bureau_a_2"
COLUMNS = fixed.LARGE_COLUMNS[G]
_P = with_(p=bound_sql(G, "customers"))
_CONTRACT_KEY = "case_id, num_group1"


def _big(expr, out):
    return f'CAST({expr} AS BIGINT) AS "{out}"'


def _above(col, n):
    return f"CASE WHEN coalesce({col}, 0) > {n} THEN 1 ELSE 0 END"


def _flag(cond, out):
    return f'max(CASE WHEN {cond} THEN 1 ELSE 0 END) AS "{out}"'


C = f"{G}__contract__"
BASIC = [
    _big("count(*)", f"{C}payment_count"), _big("count(num_group2)", f"{C}num_group2_count"),
    f'max(num_group2) AS "{C}num_group2_max"', f'min(num_group2) AS "{C}num_group2_min"',
]


def _stats(exact: bool):
    out = []
    for c in COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        for op, e in {
            "sum": f"coalesce(sum({x}), 0)", "mean": f"avg({x})", "max": f"max({x})", "min": f"min({x})",
            "std": f"stddev_samp({x})", "range": f"max({x}) - min({x})",
        }.items():
            out.append(f'{e if exact else R(e)} AS "{C}{c}__{op}"')
        out.append(_big(f"count({x})", f"{C}{c}__count"))
    return out


_DPD = ("pmts_dpd_1073P", "pmts_dpd_303P")
_OWED = ("pmts_overdue_1140A", "pmts_overdue_1152A")
OVERDUE = [
    _flag(" OR ".join(f"coalesce({c}, 0) > 0" for c in (*_DPD, *_OWED)), f"{C}has_overdue"),
    *[_big(f"sum({_above(_DPD[0], n)} + {_above(_DPD[1], n)})", f"{C}dpd_gt{n}_payment_count") for n in (0, 30, 60, 90)],
    *[_flag(f"coalesce({_DPD[0]}, 0) > {n} OR coalesce({_DPD[1]}, 0) > {n}", f"{C}has_dpd_gt{n}") for n in (30, 60, 90)],
    _big(f"sum({_above(_OWED[0], 0)} + {_above(_OWED[1], 0)})", f"{C}overdue_amt_gt0_payment_count"),
]
_SIDES = {
    "active": ("pmts_dpd_1073P", "pmts_overdue_1140A", "pmts_month_158T", "pmts_year_1139T"),
    "closed": ("pmts_dpd_303P", "pmts_overdue_1152A", "pmts_month_706T", "pmts_year_507T"),
}
SIDES, PERIODS = [], []
for _side, (_d, _o, _m, _y) in _SIDES.items():
    _used = " OR ".join(f"{c} IS NOT NULL" for c in (_d, _o, _m, _y))
    SIDES += [
        _big(f"sum(CASE WHEN {_used} THEN 1 ELSE 0 END)", f"{C}{_side}_payment_count"),
        _flag(_used, f"{C}has_{_side}_payment"),
        _big(f"sum({_above(_d, 30)})", f"{C}{_side}_dpd_gt30_payment_count"),
        _big(f"sum({_above(_o, 0)})", f"{C}{_side}_overdue_amt_gt0_payment_count"),
    ]
    _period = f"CAST({_y} * 12 + {_m} AS DOUBLE)"
    PERIODS += [
        f'max({_period}) AS "{C}{_side}_period_max"',
        f'min({_period}) AS "{C}{_side}_period_min"',
        f'max({_period}) - min({_period}) AS "{C}{_side}_period_span"',
        f'max(CASE WHEN coalesce({_d}, 0) > 30 THEN {_period} END) AS "{C}{_side}_dpd_gt30_period_max"',
    ]


def _contracts_sql(cells):
    return f"{_P} SELECT {_CONTRACT_KEY}, {', '.join(cells)} FROM p GROUP BY {_CONTRACT_KEY}"


for _name, _part, _cells in (
    ("contract_basic", "basic", BASIC),
    ("contract_column_stats", "stats", _stats(False)),
    ("contract_overdue_flags", "overdue", OVERDUE),
    ("contract_active_closed", "sides", SIDES),
    ("contract_periods", "periods", PERIODS),
):

    @query(_name, _contracts_sql(_cells))
    def _contract(spark, sf, part=_part):
        return rounded(contract_table(frame(spark, sf, G, "customers"), G, parts=[part]))


_CONTRACT_CTE = (
    f"c AS (SELECT {_CONTRACT_KEY}, {', '.join([*BASIC, *_stats(True), *OVERDUE, *SIDES, *PERIODS])} FROM p"
    f" GROUP BY {_CONTRACT_KEY})"
)
_PAYMENTS = f'"{C}payment_count"'
_CASE = [
    _big("count(*)", f"{G}__contract_count"),
    _big(f"sum({_PAYMENTS})", f"{G}__payment_count"),
    _big(f"max({_PAYMENTS})", f"{G}__payment_count_contract_max"),
    f'{R(f"avg({_PAYMENTS})")} AS "{G}__payment_count_contract_mean"',
    _big(f'sum("{C}has_overdue")', f"{G}__overdue_contract_count"),
]
_SUMMED = [
    *[f"dpd_gt{n}_payment_count" for n in (0, 30, 60, 90)], "overdue_amt_gt0_payment_count",
    *[f"has_dpd_gt{n}" for n in (30, 60, 90)],
    *[f"{s}_payment_count" for s in _SIDES], *[f"has_{s}_payment" for s in _SIDES],
    *[f"{s}_dpd_gt30_payment_count" for s in _SIDES], *[f"{s}_overdue_amt_gt0_payment_count" for s in _SIDES],
]
_CASE += [_big(f'sum("{C}{n}")', f"{G}__{n}") for n in _SUMMED]
for _side in _SIDES:
    _CASE += [f'max("{C}{_side}_{n}") AS "{G}__{_side}_{n}"' for n in ("period_max", "period_span", "dpd_gt30_period_max")]
    _CASE.append(f'min("{C}{_side}_period_min") AS "{G}__{_side}_period_min"')

_CASE_STATS = []
for _c in COLUMNS:
    _s = lambda op, c=_c: f'"{C}{c}__{op}"'
    for _out, _e in {
        "sum": f"sum({_s('sum')})",
        "mean": f"CASE WHEN sum({_s('count')}) > 0 THEN sum({_s('sum')}) / sum({_s('count')}) END",
        "max": f"max({_s('max')})", "min": f"min({_s('min')})",
        "contract_mean_mean": f"avg({_s('mean')})", "contract_mean_max": f"max({_s('mean')})",
        "contract_std_mean": f"avg({_s('std')})", "contract_range_max": f"max({_s('range')})",
    }.items():
        _CASE_STATS.append(f'{R(_e)} AS "{G}__{_c}__{_out}"')
    _CASE_STATS.append(_big(f"sum({_s('count')})", f"{G}__{_c}__count"))


def _case_sql(cells):
    return f"{_P}, {_CONTRACT_CTE} SELECT case_id, {', '.join(cells)} FROM c GROUP BY case_id"


@query("case_from_contracts", _case_sql(_CASE))
def q_case(spark, sf):
    contracts = contract_table(frame(spark, sf, G, "customers"), G, parts=["basic", "overdue", "sides", "periods"])
    return rounded(contracts.groupBy("case_id").agg(*case_from_contracts(contracts, G)))


@query("case_column_stats", _case_sql(_CASE_STATS))
def q_case_stats(spark, sf):
    contracts = contract_table(frame(spark, sf, G, "customers"), G, parts=["stats"])
    return rounded(contracts.groupBy("case_id").agg(*case_column_stats(contracts, G)))


@query("case_final_merge", _case_sql([*_CASE, *_CASE_STATS]))
def q_case_final(spark, sf):
    """Two halves of the payments as separate inputs; the result is that of the whole."""
    rows = frame(spark, sf, G, "customers")
    first = rows.where(F.col("num_group2") % 2 == 0)
    second = rows.where(F.col("num_group2") % 2 == 1)
    return rounded(aggregate_two_stage(first.unionByName(second), G))
