"""Binds the given tables to base, depth-0 and child groups of the feature build.

A binding is a FROM clause and a list of (column, expression, kind). The expressions are plain
SQL that both Spark and the checking database read; ``DAYS(x)`` stands for days since
1970-01-01 and is spelled per engine. Date columns reach Spark as ISO text, as a raw file
would hold them, and reach the check as day numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from evenkeel.operators.skew import HOT_ROWS
from evenkeel.sources.keyed import split_by_key
from evenkeel.sources.tables import FrameSource

# A case is an order, its child rows are the lines.
LINE = "lineitem"
LINE_KEY = ("case_id", "l_orderkey", "num")
# Unique inside an order, so that first and last are well defined.
LINE_ORDINAL = (
    "num_group1",
    "CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 1000000000 + l_suppkey * 100"
    " + CAST(l_quantity AS BIGINT)",
    "num",
)
OUTER = ("num_group1", "CAST(l_linenumber AS BIGINT)", "num")
INNER = ("num_group2", "l_partkey * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT)", "num")


def _lines(*columns, depth: int = 1):
    head = [LINE_KEY, LINE_ORDINAL] if depth == 1 else [LINE_KEY, OUTER, INNER]
    return (LINE, [*head, *columns])


PRICE = "l_extendedprice"
PRICE_GAPS = "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice END"
TAXED = "CASE WHEN l_linestatus = 'O' THEN l_quantity * l_tax END"
FLAG_GAPS = "CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END"
LATE = "CASE WHEN l_quantity > 25 THEN l_quantity - 25 END"

ORDERS: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "base": (
        "orders",
        [
            ("case_id", "o_orderkey", "num"),
            ("date_decision", "o_orderdate", "date"),
            ("MONTH", "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)", "num"),
            ("WEEK_NUM", "CAST(floor((DAYS(o_orderdate) - 9131) / 7.0) AS INT)", "num"),
            ("target", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END", "num"),
        ],
    ),
    "static_0": (
        "orders",
        [
            ("case_id", "o_orderkey", "num"),
            ("credamount_770A", "o_totalprice", "num"),
            ("annuity_780A", "o_totalprice / (1 + o_custkey % 12)", "num"),
            ("annuitynextmonth_57A", "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice * 0.02 END", "num"),
            ("currdebt_22A", "CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.25 END", "num"),
            ("disbursedcredamount_1113A", "o_totalprice * 0.5", "num"),
            ("downpmt_116A", "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_totalprice * 0.125 END", "num"),
            ("maxannuity_159A", "o_totalprice / (1 + o_custkey % 5)", "num"),
            ("lastapprcredamount_781A", "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice * 0.75 END", "num"),
            ("lastrejectcredamount_222A", "CASE WHEN o_custkey % 5 = 0 THEN o_totalprice END", "num"),
            ("applicationcnt_361L", "o_custkey % 7", "num"),
            ("firstclxcampaign_1125D", "o_orderdate", "date"),
        ],
    ),
    "static_cb_0": (
        "orders JOIN customer ON o_custkey = c_custkey",
        [
            ("case_id", "o_orderkey", "num"),
            ("numberofqueries_373L", "c_nationkey", "num"),
            ("pmtssum_45A", "c_acctbal", "num"),
            ("responsedate_1012D", "CASE WHEN c_nationkey > 20 THEN NULL ELSE o_orderdate END", "date"),
            ("education_88M", "CASE WHEN c_nationkey < 3 THEN NULL ELSE c_mktsegment END", "text"),
        ],
    ),
    "applprev_1": _lines(
        ("annuity_853A", PRICE_GAPS, "num"),
        ("credamount_590A", PRICE, "num"),
        ("currdebt_94A", TAXED, "num"),
        ("downpmt_134A", "l_extendedprice * l_tax", "num"),
        ("actualdpd_943P", LATE, "num"),
        ("maxdpdtolerance_577P", "l_quantity - 10", "num"),
        ("pmtnum_254L", "l_quantity", "num"),
        ("interestrate_311T", "l_discount", "num"),
        ("creationdate_885D", "l_shipdate", "date"),
        ("cancelreason_3545846M", FLAG_GAPS, "text"),
        ("isbidproduct_390L", "l_discount > 0.05", "flag"),
    ),
    "applprev_2": _lines(
        ("cacccardblochreas_147M", FLAG_GAPS, "text"),
        ("conts_type_509L", "l_linestatus", "text"),
        ("credacc_cards_status_52L", "CASE WHEN l_tax > 0.06 THEN NULL ELSE l_returnflag END", "text"),
        ("cards_1L", "l_quantity", "num"),
        depth=2,
    ),
    "person_1": _lines(
        ("birth_259D", "l_shipdate", "date"),
        ("empl_employedfrom_271D", "CASE WHEN l_tax > 0.06 THEN NULL ELSE l_shipdate END", "date"),
        ("empl_employedtotal_800L", "CASE WHEN l_linestatus = 'O' THEN 'MORE_ONE' ELSE 'LESS_ONE' END", "text"),
        ("empl_industry_691L", FLAG_GAPS, "text"),
        ("familystate_447L", "l_returnflag", "text"),
        ("incometype_1044T", "CASE WHEN l_returnflag = 'R' THEN 'SELFEMPLOYED' ELSE 'SALARIED_GOVT' END", "text"),
        ("sex_738L", "l_linestatus", "text"),
        ("housetype_905L", FLAG_GAPS, "text"),
        ("isreference_387L", "l_discount > 0.05", "flag"),
        ("mainoccupationinc_384A", PRICE_GAPS, "num"),
        ("childnum_185L", "l_quantity", "num"),
    ),
    "person_2": _lines(
        ("empls_economicalst_849M", FLAG_GAPS, "text"),
        ("empls_employedfrom_796D", "CASE WHEN l_tax > 0.06 THEN NULL ELSE l_shipdate END", "date"),
        ("empls_employer_name_740M", "l_linestatus", "text"),
        depth=2,
    ),
    "deposit_1": _lines(("amount_416A", PRICE_GAPS, "num"), ("openingdate_313D", "l_shipdate", "date")),
    "debitcard_1": _lines(
        ("last180dayaveragebalance_704A", TAXED, "num"), ("openingdate_857D", "l_shipdate", "date")
    ),
    "other_1": _lines(
        ("amtdepositbalance_4809441A", PRICE_GAPS, "num"),
        ("amtdebitincoming_4809443A", TAXED, "num"),
        ("status_1M", FLAG_GAPS, "text"),
    ),
    "tax_registry_a_1": _lines(
        ("amount_4527230A", PRICE_GAPS, "num"),
        ("recorddate_4527225D", "l_shipdate", "date"),
        ("name_4527232M", FLAG_GAPS, "text"),
    ),
    "tax_registry_b_1": _lines(("amount_4917619A", TAXED, "num"), ("deductiondate_4917603D", "l_shipdate", "date")),
    "tax_registry_c_1": _lines(
        ("pmtamount_36A", PRICE, "num"),
        ("processingdate_168D", "l_shipdate", "date"),
        ("employername_160M", FLAG_GAPS, "text"),
    ),
    "credit_bureau_a_1": _lines(
        ("dpdmax_139P", LATE, "num"),
        ("dpdmax_757P", "l_quantity - 20", "num"),
        ("overdueamountmax_155A", TAXED, "num"),
        ("overdueamount_31A", "l_extendedprice * l_tax", "num"),
        ("outstandingamount_354A", PRICE_GAPS, "num"),
        ("totaloutstanddebtvalue_39A", PRICE, "num"),
        ("credlmt_230A", "l_extendedprice * 2", "num"),
        ("totalamount_6A", "l_extendedprice * 4", "num"),
        ("nominalrate_281L", "l_discount", "num"),
        ("numberofinstls_229L", "l_quantity", "num"),
        ("numberofoverdueinstlmax_1039L", "CAST(l_linenumber AS INT)", "num"),
        ("dateofcredstart_181D", "l_shipdate", "date"),
        ("lastupdate_388D", "CASE WHEN l_tax > 0.06 THEN NULL ELSE l_shipdate END", "date"),
        ("refreshdate_3813885D", "l_shipdate", "date"),
        ("contractst_545M", FLAG_GAPS, "text"),
    ),
    "credit_bureau_b_1": _lines(
        ("amount_1115A", PRICE_GAPS, "num"), ("dpd_550P", LATE, "num"), ("contractdate_551D", "l_shipdate", "date"),
        ("classification_1M", FLAG_GAPS, "text"),
    ),
    "credit_bureau_b_2": _lines(
        ("pmts_dpdvalue_108P", LATE, "num"), ("pmts_pmtsoverdue_635A", TAXED, "num"), depth=2
    ),
    "credit_bureau_a_2": _lines(
        ("pmts_dpd_1073P", "CASE WHEN l_linestatus = 'O' THEN l_quantity * 3 - 30 END", "num"),
        ("pmts_dpd_303P", "CASE WHEN l_linestatus = 'F' THEN l_quantity * 3 - 30 END", "num"),
        ("pmts_overdue_1140A", "CASE WHEN l_linestatus = 'O' THEN l_extendedprice * l_discount END", "num"),
        ("pmts_overdue_1152A", "CASE WHEN l_linestatus = 'F' THEN l_extendedprice * l_discount END", "num"),
        ("pmts_month_158T", "CASE WHEN l_linestatus = 'O' THEN month(l_shipdate) END", "num"),
        ("pmts_month_706T", "CASE WHEN l_linestatus = 'F' THEN month(l_shipdate) END", "num"),
        ("pmts_year_1139T", "CASE WHEN l_linestatus = 'O' THEN year(l_shipdate) END", "num"),
        ("pmts_year_507T", "CASE WHEN l_linestatus = 'F' THEN year(l_shipdate) END", "num"),
        ("collater_valueofguarantee_1124L", PRICE_GAPS, "num"),
        ("collater_typofvalofguarant_298M", FLAG_GAPS, "text"),
        depth=2,
    ),
}

# A case is a customer, a contract an order, a payment a line.
_PAY_FROM = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_DPD = "CAST(greatest(0, DAYS(l_shipdate) - DAYS(o_orderdate)) AS DOUBLE)"
CUSTOMERS = {
    "credit_bureau_a_2": (
        _PAY_FROM,
        [
            ("case_id", "o_custkey", "num"),
            ("num_group1", "o_orderkey", "num"),
            ("num_group2", "CAST(l_linenumber AS BIGINT)", "num"),
            *[
                (name, f"CASE WHEN l_linestatus = '{side}' THEN {expr} END", "num")
                for side, names in {
                    "O": ("pmts_dpd_1073P", "pmts_overdue_1140A", "pmts_month_158T", "pmts_year_1139T"),
                    "F": ("pmts_dpd_303P", "pmts_overdue_1152A", "pmts_month_706T", "pmts_year_507T"),
                }.items()
                for name, expr in zip(
                    names, (_DPD, "l_extendedprice * l_discount", "month(l_shipdate)", "year(l_shipdate)")
                )
            ],
        ],
    ),
}
BINDINGS = {"orders": ORDERS, "customers": CUSTOMERS}
# The columns that become the case of the first binding.
CASE_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_DAYS = re.compile(r"DAYS\((\w+)\)")


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A given table; its schema is read from the footer once per process."""
    path = f"{sf.rstrip('/')}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def frame(
    spark: SparkSession, sf: str, group: str, binding: str = "orders", tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """A bound group as a DataFrame; ``tables`` stand in for given ones."""
    origin, columns = BINDINGS[binding][group]
    cells = []
    for name, expr, kind in columns:
        expr = _DAYS.sub(r"unix_date(CAST(\1 AS DATE))", expr)
        if kind == "date":
            expr = f"CAST(CAST({expr} AS DATE) AS STRING)"
        cells.append(f"{expr} AS {name}")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", origin)]
    for t in used:
        origin = re.sub(rf"\b{t}\b", "{" + t + "}", origin)
    return spark.sql(f"SELECT {', '.join(cells)} FROM {origin}", **{t: tables[t] if tables and t in tables else read(spark, sf, t) for t in used})


def source(
    spark: SparkSession, sf: str, binding: str = "orders", tables: Mapping[str, DataFrame] | None = None
) -> FrameSource:
    return FrameSource(_LazyFrames(spark, sf, binding, tables))


def by_case(
    spark: SparkSession, sf: str, run: Callable[[FrameSource, int | None], DataFrame], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``run(source, hot_rows)`` over tables that are stored by case, so many groups share one exchange of each table.

    Rows without a case and cases with more than ``hot_rows`` rows in a table are run apart, over the given files; None says that there are none.
    """
    cold, rest = split_by_key({t: (read(spark, sf, t), key) for t, key in CASE_KEYS.items()}, hot_rows)
    out = run(source(spark, sf, tables=cold), None)
    return out if rest is None else out.unionByName(run(source(spark, sf, tables=rest), hot_rows))


class _LazyFrames(dict):
    """Group name -> DataFrame, built when asked for."""

    def __init__(self, spark: SparkSession, sf: str, binding: str, tables: Mapping[str, DataFrame] | None = None):
        super().__init__()
        self._args = (spark, sf, binding, tables)

    def __iter__(self):
        return iter(BINDINGS[self._args[2]])

    def __contains__(self, group: object) -> bool:
        return group in BINDINGS[self._args[2]]

    def __missing__(self, group: str) -> DataFrame:
        spark, sf, binding, tables = self._args
        self[group] = frame(spark, sf, group, binding, tables)
        return self[group]


@lru_cache(maxsize=None)
def bound_sql(group: str, binding: str = "orders") -> str:
    """The same group as a SELECT for the check, dates as day numbers."""
    origin, columns = BINDINGS[binding][group]
    cells = []
    for name, expr, kind in columns:
        expr = _DAYS.sub(r"(CAST(\1 AS DATE) - DATE '1970-01-01')", expr)
        if kind == "date":
            expr = f"CAST(CAST({expr} AS DATE) - DATE '1970-01-01' AS INTEGER)"
        cells.append(f"{expr} AS {name}")
    return f"SELECT {', '.join(cells)} FROM {origin}"
