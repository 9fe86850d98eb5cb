"""Derived features of the wide table, declared as a list of small formulas."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.functions.naming import DEFAULT, Naming
from evenkeel.functions.scalar import (
    age_years,
    has_record,
    log1p_count,
    max_of_row,
    min_of_row,
    null_count_row,
    safe_div,
    safe_ratio,
    to_double,
)
from evenkeel.plans.presets import parse_feature_set

PAY = f"{fixed.PAYMENTS}__"
BUREAU = "credit_bureau_a_1__"


@dataclass(frozen=True)
class Formula:
    """``build`` sees the available columns of every input set; all sets must be non-empty."""

    out: str
    inputs: tuple[tuple[str, ...], ...]
    build: Callable[..., Column]
    whole: bool = False  # every listed column has to exist, not just one per set

    def resolve(self, have: set[str]) -> Column | None:
        sets = [[c for c in names if c in have] for names in self.inputs]
        if any(not s for s in sets):
            return None
        if self.whole and any(len(s) != len(n) for s, n in zip(sets, self.inputs)):
            return None
        return self.build(*[[to_double(c) for c in s] for s in sets])


def ratio(out: str, num: str, den: str) -> Formula:
    return Formula(f"derived__{out}", ((num,), (den,)), lambda n, d: safe_ratio(n[0], d[0]))


def quotient(out: str, nums: Sequence[str], dens: Sequence[str]) -> Formula:
    return Formula(
        f"derived__{out}", (tuple(nums), tuple(dens)), lambda n, d: safe_div(max_of_row(n), max_of_row(d))
    )


def minus(out: str, a: str, b: str) -> Formula:
    return Formula(out, ((a,), (b,)), lambda x, y: x[0] - y[0])


def row_max(out: str, names: Sequence[str]) -> Formula:
    return Formula(f"derived__{out}", (tuple(names),), lambda xs: max_of_row(xs))


def value_range(stem: str) -> Formula:
    return minus(f"{stem}__range", f"{stem}__max", f"{stem}__min")


def _top(names: Sequence[str]) -> list[str]:
    return [f"{BUREAU}{c}__max" for c in names]


# --- component formulas -------------------------------------------------------------------


def delinquency(components: frozenset[str]) -> list[Formula]:
    full, narrow = "a2_delinquency" in components, "a2_dpd30_contract" in components
    contracts, payments = f"{PAY}contract_count", f"{PAY}payment_count"
    both = [contracts, payments]

    def per_contract(out: str, num: str) -> Formula:
        # Contract rates appear only beside both counts.
        return Formula(
            f"derived__{out}", ((num,), tuple(both)), lambda n, d: safe_ratio(n[0], d[0]), whole=True
        )

    out = []
    if full:
        out.append(per_contract("a2_overdue_contract_rate", f"{PAY}overdue_contract_count"))
    if not narrow:
        out.append(per_contract("a2_payment_per_contract", payments))
    for n in (30,) if narrow else (30, 60, 90):
        out.append(per_contract(f"a2_dpd_gt{n}_contract_rate", f"{PAY}has_dpd_gt{n}"))
    if full:
        for n in fixed.DPD_LIMITS:
            out.append(ratio(f"a2_dpd_gt{n}_payment_rate", f"{PAY}dpd_gt{n}_payment_count", payments))
        out.append(ratio("a2_overdue_amt_gt0_payment_rate", f"{PAY}overdue_amt_gt0_payment_count", payments))
    return out


def payment_mix() -> list[Formula]:
    out = []
    for side in fixed.PAYMENT_SIDES:
        out.append(ratio(f"a2_{side}_payment_share", f"{PAY}{side}_payment_count", f"{PAY}payment_count"))
        out.append(ratio(f"a2_{side}_contract_rate", f"{PAY}has_{side}_payment", f"{PAY}contract_count"))
    kinds = {"dpd_gt30": "dpd_gt30_rate", "overdue_amt_gt0": "overdue_amt_rate"}
    for kind, short in kinds.items():
        pairs = [(f"{PAY}{s}_{kind}_payment_count", f"{PAY}{s}_payment_count") for s in fixed.PAYMENT_SIDES]
        for side, (num, den) in zip(fixed.PAYMENT_SIDES, pairs):
            out.append(ratio(f"a2_{side}_{kind}_payment_rate", num, den))
        out.append(
            Formula(
                f"derived__a2_active_minus_closed_{short}",
                tuple((c,) for pair in pairs for c in pair),
                lambda an, ad, cn, cd: F.coalesce(safe_div(an[0], ad[0]), F.lit(0.0))
                - F.coalesce(safe_div(cn[0], cd[0]), F.lit(0.0)),
            )
        )
    return out


def temporal() -> list[Formula]:
    out = []
    for side in fixed.PAYMENT_SIDES:
        span, last = f"{PAY}{side}_period_span", f"{PAY}{side}_period_max"
        out.append(ratio(f"a2_{side}_period_span_ratio", span, last))
        out.append(
            minus(f"derived__a2_{side}_bad_latest_period_gap", last, f"{PAY}{side}_dpd_gt30_period_max")
        )
    out.append(
        minus("derived__a2_active_closed_latest_period_delta", f"{PAY}active_period_max", f"{PAY}closed_period_max")
    )
    return out


def person(full: bool) -> list[Formula]:
    income, birth = f"person_1__{fixed.PERSON_INCOME}__max", "person_1__birth_259D__first"
    out = [Formula("derived__person_age_years", ((birth,),), lambda b: age_years(b[0]))]
    if full:
        out += [
            ratio("income_to_credamount", income, "credamount_770A"),
            ratio("annuity_to_income", "annuity_780A", income),
            ratio("currdebt_to_income", "currdebt_22A", income),
            quotient("employment_age_ratio", ["person_1__empl_employedtotal_800L__first"], [birth]),
        ]
    return out


def bureau(full: bool) -> list[Formula]:
    overdue, outstanding = _top(fixed.BUREAU_OVERDUE_AMOUNTS), _top(fixed.BUREAU_OUTSTANDING)
    out = [
        row_max("bureau_a1_max_dpd", _top(fixed.BUREAU_DPD)),
        row_max("bureau_a1_overdue_instl_max", _top(fixed.BUREAU_OVERDUE_INSTALMENTS)),
        row_max("bureau_a1_overdue_amount_max", overdue),
        Formula(
            "derived__bureau_a1_any_overdue_amount",
            (tuple(overdue),),
            lambda xs: (F.coalesce(max_of_row(xs), F.lit(0.0)) > 0).cast("int"),
        ),
        quotient("bureau_a1_overdue_to_outstanding", overdue, outstanding),
    ]
    if full:
        out += [
            row_max("bureau_a1_outstanding_debt_max", outstanding),
            quotient("bureau_a1_debt_to_credit_limit", outstanding, _top(fixed.BUREAU_LIMITS)),
            quotient("bureau_a1_outstanding_to_total_amount", outstanding, _top(fixed.BUREAU_TOTALS)),
            Formula(
                "derived__bureau_a1_recent_update_gap",
                (tuple(f"{BUREAU}{c}__min" for c in fixed.BUREAU_UPDATES),),
                lambda xs: min_of_row(xs),
            ),
        ]
    # Alternatives in order of preference; the first that resolves is kept.
    out += [minus("derived__bureau_a1_credit_age_span", f"{BUREAU}{c}__max", f"{BUREAU}{c}__min") for c in fixed.BUREAU_STARTS]
    return out


def previous(full: bool) -> list[Formula]:
    p, top = "applprev_1__", "applprev_1__credamount_590A__max"
    out = [
        row_max("prev_max_dpd", [f"{p}actualdpd_943P__max", f"{p}maxdpdtolerance_577P__max"]),
        quotient("prev_dpd_per_application", [f"{p}maxdpdtolerance_577P__max"], [f"{p}row_count"]),
    ]
    if full:
        out += [
            ratio("prev_credit_mean_to_current", f"{p}credamount_590A__mean", "credamount_770A"),
            ratio("prev_credit_max_to_current", top, "credamount_770A"),
            ratio("prev_annuity_max_to_current", f"{p}annuity_853A__max", "annuity_780A"),
            ratio("prev_debt_max_to_credit_max", f"{p}currdebt_94A__max", top),
            ratio("prev_downpmt_max_to_credit_max", f"{p}downpmt_134A__max", top),
        ]
    return out


def payments(full: bool) -> list[Formula]:
    dpd = [f"{PAY}{s['dpd']}__max" for s in fixed.PAYMENT_SIDES.values()]
    active, closed = [f"{PAY}{s['overdue']}__sum" for s in fixed.PAYMENT_SIDES.values()]
    count = f"{PAY}payment_count"
    out = [
        row_max("a2_max_dpd", dpd),
        minus("derived__a2_active_closed_max_dpd_delta", *dpd),
        ratio("a2_dpd30_to_dpd0_rate", f"{PAY}dpd_gt30_payment_count", f"{PAY}dpd_gt0_payment_count"),
        ratio("a2_dpd90_to_dpd30_rate", f"{PAY}dpd_gt90_payment_count", f"{PAY}dpd_gt30_payment_count"),
        ratio("a2_active_overdue_amount_per_payment", active, count),
        Formula(
            "derived__a2_overdue_amount_per_payment",
            ((active,), (closed,), (count,)),
            lambda a, c, n: safe_div(a[0] + c[0], n[0]),
        ),
    ]
    if full:
        out.append(ratio("a2_closed_overdue_amount_per_payment", closed, count))
    return out


def ranges_by_word(columns: Sequence[str]) -> list[Formula]:
    """Ranges of all money-like max/min pairs, in column order."""
    have = set(columns)
    stems = [c[: -len("__max")] for c in columns if c.endswith("__max")]
    wanted = [s for s in stems if f"{s}__min" in have and any(w in f"{s}__max".lower() for w in fixed.RANGE_WORDS)]
    return [value_range(s) for s in wanted]


def component_formulas(components: frozenset[str], columns: Sequence[str]) -> list[Formula]:
    out: list[Formula] = []
    if "ratios" in components:
        out += [ratio(o, n, d) for o, n, d in fixed.RATIOS]
    if "ranges_stable" in components:
        out += [value_range(s) for s in fixed.STABLE_RANGES]
    if "ranges" in components:
        out += ranges_by_word(columns)
    if components & {"a2_delinquency", "a2_delinquency_stable", "a2_dpd30_contract"}:
        out += delinquency(components)
    if "a2_payment_mix" in components:
        out += payment_mix()
    if "a2_temporal" in components:
        out += temporal()
    if components & {"semantic_v2", "semantic_v2_stable"}:
        full = "semantic_v2" in components
        for part in (person, bureau, previous, payments):
            out += part(full)
    return out


def missing_counts(columns: Sequence[str], naming: Naming = DEFAULT) -> dict[str, Column]:
    features = [c for c in columns if c not in (naming.key, naming.target)]
    amounts = [c for c in features if c.endswith("A")]
    out = {}
    if features:
        out["derived__null_count"] = null_count_row(features)
    if amounts:
        out["derived__amount_null_count"] = null_count_row(amounts)
    return out


def record_counts(columns: Sequence[str]) -> dict[str, Column]:
    out = {}
    for c in columns:
        if c.endswith("__row_count"):
            out[f"{c}__has_record"] = has_record(to_double(c))
            out[f"{c}__log1p"] = log1p_count(to_double(c))
    return out


def derive(df: DataFrame, feature_set: str, naming: Naming = DEFAULT) -> DataFrame:
    """All derived columns of a feature set in one projection; formulas without inputs are left out."""
    components = parse_feature_set(feature_set)
    out: dict[str, Column] = {}
    if "missing" in components:
        out |= missing_counts(df.columns, naming)
    if "counts" in components:
        out |= record_counts(df.columns)
    have = set(df.columns)
    for formula in component_formulas(components, df.columns):
        column = formula.resolve(have)
        if column is not None and formula.out not in out:
            out[formula.out] = column
    return df.withColumns(out) if out else df


# --- static output names --------------------------------------------------------------------

TWO_STAGE_COUNTS = (
    "contract_count", "payment_count", "payment_count_contract_max", "payment_count_contract_mean",
    "overdue_contract_count",
)
TWO_STAGE_STATS = (
    "sum", "count", "mean", "max", "min", "contract_mean_mean", "contract_mean_max", "contract_std_mean",
    "contract_range_max",
)


def _payment_sources(components: frozenset[str]) -> list[str]:
    """Payment-level columns that a component passes through beside its derived ones."""
    sides = tuple(fixed.PAYMENT_SIDES)
    out: list[str] = []
    if "a2_twostage" in components:
        out += TWO_STAGE_COUNTS
        out += [f"{c}__{s}" for c in fixed.LARGE_COLUMNS[fixed.PAYMENTS] for s in TWO_STAGE_STATS]
    if "a2_delinquency" in components:
        out += [f"dpd_gt{n}_payment_count" for n in fixed.DPD_LIMITS] + ["overdue_amt_gt0_payment_count"]
    if components & {"a2_delinquency", "a2_delinquency_stable"}:
        out += [f"has_dpd_gt{n}" for n in (30, 60, 90)]
    if "a2_delinquency_stable" in components:
        out += [f"dpd_gt{n}_payment_count" for n in (30, 60, 90)]
    if "a2_dpd30_contract" in components:
        out.append("has_dpd_gt30")
    if "a2_payment_mix" in components:
        for kind in ("{}_payment_count", "has_{}_payment", "{}_dpd_gt30_payment_count", "{}_overdue_amt_gt0_payment_count"):
            out += [kind.format(s) for s in sides]
    if "a2_temporal" in components:
        for kind in ("period_max", "period_min", "period_span", "dpd_gt30_period_max"):
            out += [f"{s}_{kind}" for s in sides]
    return [f"{PAY}{c}" for c in dict.fromkeys(out)]


def derived_output_columns(feature_set: str) -> list[str]:
    """Names a feature set adds when all its inputs exist (row counts and free ranges aside)."""
    components = parse_feature_set(feature_set)
    out = ["derived__null_count", "derived__amount_null_count"] if "missing" in components else []
    out += _payment_sources(components)
    listed = component_formulas(components - {"ranges", "counts", "missing"}, [])
    return list(dict.fromkeys(out + [f.out for f in listed]))


def source_columns(outputs: Sequence[str], feature_set: str) -> set[str]:
    """Outputs plus every wide-table column their formulas read."""
    components = parse_feature_set(feature_set)
    wanted = set(outputs)
    stems = [c for c in outputs if c.endswith("__range")]
    formulas = component_formulas(components - {"ranges"}, [])
    if "ranges" in components:
        formulas += [value_range(c[: -len("__range")]) for c in stems]
    for f in formulas:
        if f.out in wanted:
            wanted |= {c for names in f.inputs for c in names}
    if "counts" in components:
        wanted |= {c.rsplit("__", 1)[0] for c in outputs if "__row_count__" in c}
    return wanted
