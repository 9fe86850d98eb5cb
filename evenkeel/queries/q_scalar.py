"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import scalar as S
from evenkeel.operators.encode import standardize_features
from evenkeel.operators.lab import listed_json
from evenkeel.queries.bindings import bound_sql, frame, read
from evenkeel.queries.registry import R, bound, query, rounded, with_

_BASE = with_(**bound("base"))
_DAY = "(CAST({} AS DATE) - DATE '1970-01-01')"


def _orders(spark, sf):
    return read(spark, sf, "orders")


def _lines(spark, sf):
    return read(spark, sf, "lineitem")


@query(
    "to_double_lenient",
    "SELECT o_orderkey, TRY_CAST(CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE)"
    " AS x FROM orders",
)
def q_double(spark, sf):
    text = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))
    return _orders(spark, sf).select("o_orderkey", S.to_double(text).alias("x"))


@query(
    "normalize_dates",
    f"SELECT o_orderkey, CAST({_DAY.format('o_orderdate')} AS INTEGER) AS date_decision,"
    f" CASE WHEN o_custkey % 2 = 0 THEN CAST({_DAY.format('o_orderdate')} AS INTEGER) END AS text_1D, o_custkey AS number_2D FROM orders",
)
def q_dates(spark, sf):
    iso = F.col("o_orderdate").cast("date").cast("string")
    rows = _orders(spark, sf).select(
        "o_orderkey", F.col("o_orderdate").alias("date_decision"),
        F.when(F.col("o_custkey") % 2 == 0, iso).otherwise(F.lit("not a date")).alias("text_1D"),
        F.col("o_custkey").alias("number_2D"),
    )
    return S.normalize_dates(rows)


_DATED = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _dated(spark, sf):
    both = _lines(spark, sf).join(_orders(spark, sf), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        "l_orderkey", "l_linenumber", F.unix_date(F.col("l_shipdate").cast("date")).alias("event"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("decision"),
    )


@query("days_before_decision", f"SELECT l_orderkey, l_linenumber, CAST(CAST(o_orderdate AS DATE) - CAST(l_shipdate AS DATE) AS DOUBLE) AS d FROM {_DATED}")
def q_before(spark, sf):
    return _dated(spark, sf).select("l_orderkey", "l_linenumber", S.days_before("decision", "event").alias("d"))


@query("days_after_decision", f"SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS DOUBLE) AS d FROM {_DATED}")
def q_after(spark, sf):
    return _dated(spark, sf).select("l_orderkey", "l_linenumber", S.days_after("event", "decision").alias("d"))


@query("decision_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS decision_month FROM orders")
def q_month(spark, sf):
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return _orders(spark, sf).select("o_orderkey", S.decision_month(day).alias("decision_month"))


@query("decision_weekday", "SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS decision_weekday FROM orders")
def q_weekday(spark, sf):
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return _orders(spark, sf).select("o_orderkey", S.decision_weekday(day).alias("decision_weekday"))


_DEN = "(o_custkey % 7 - 2)"


@query("safe_div", f"SELECT o_orderkey, CASE WHEN {_DEN} > 0 THEN {R(f'o_totalprice / {_DEN}')} END AS q FROM orders")
def q_div(spark, sf):
    return rounded(_orders(spark, sf).select("o_orderkey", S.safe_div(F.col("o_totalprice"), F.expr(_DEN)).alias("q")))


@query("safe_ratio", f"SELECT o_orderkey, CASE WHEN abs({_DEN}) > 1e-6 THEN {R(f'o_totalprice / {_DEN}')} END AS q FROM orders")
def q_ratio(spark, sf):
    return rounded(_orders(spark, sf).select("o_orderkey", S.safe_ratio(F.col("o_totalprice"), F.expr(_DEN)).alias("q")))


@query("log1p_count", f"SELECT l_orderkey, {R('ln(1 + count(*))')} AS x FROM lineitem GROUP BY 1")
def q_log1p(spark, sf):
    return rounded(_lines(spark, sf).groupBy("l_orderkey").agg(S.log1p_count(F.count(F.lit(1))).alias("x")))


@query(
    "has_record",
    "SELECT o_orderkey, CASE WHEN n > 0 THEN 1 WHEN n IS NULL THEN NULL ELSE 0 END AS has_record FROM orders"
    " LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def q_has(spark, sf):
    n = _lines(spark, sf).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = _orders(spark, sf).join(n, "o_orderkey", "left")
    return joined.select("o_orderkey", S.has_record(F.col("n")).alias("has_record"))


_STATIC = with_(**bound("static_0"))
_GAPPY = ("currdebt_22A", "annuitynextmonth_57A", "lastapprcredamount_781A", "lastrejectcredamount_222A", "downpmt_116A")
_AS = [f"CAST({c} AS DOUBLE)" for c in _GAPPY]


def _static(spark, sf):
    return frame(spark, sf, "static_0")


@query(
    "null_count_row",
    f"{_STATIC} SELECT case_id, CAST({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in _GAPPY)} AS INTEGER) AS n FROM static_0",
)
def q_nulls(spark, sf):
    return _static(spark, sf).select("case_id", S.null_count_row(_GAPPY).alias("n"))


@query("any_of_row", "SELECT l_orderkey, l_linenumber, l_quantity > 40 OR l_tax > 0.06 OR l_returnflag = 'R' AS hit FROM lineitem")
def q_any(spark, sf):
    parts = [F.col("l_quantity") > 40, F.col("l_tax") > 0.06, F.col("l_returnflag") == "R"]
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", S.any_of_row(parts).alias("hit"))


@query("sum_of_row", f"SELECT l_orderkey, l_linenumber, {R('l_quantity + l_tax + l_discount')} AS total FROM lineitem")
def q_sum(spark, sf):
    parts = [F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")]
    return rounded(_lines(spark, sf).select("l_orderkey", "l_linenumber", S.sum_of_row(parts).alias("total")))


@query("max_of_row", f"{_STATIC} SELECT case_id, {R(f'greatest({chr(44).join(_AS)})')} AS top FROM static_0")
def q_max(spark, sf):
    return rounded(_static(spark, sf).select("case_id", S.max_of_row([S.to_double(c) for c in _GAPPY]).alias("top")))


@query("min_of_row", f"{_STATIC} SELECT case_id, {R(f'least({chr(44).join(_AS)})')} AS low FROM static_0")
def q_min(spark, sf):
    return rounded(_static(spark, sf).select("case_id", S.min_of_row([S.to_double(c) for c in _GAPPY]).alias("low")))


@query(
    "hash_string",
    f"SELECT case_id, CAST(coalesce(('0x' || md5('{S.HASH_SEED}:' || education_88M)[1:15])::BIGINT % {S.HASH_MODULUS}, -1) AS INTEGER) AS education_88M"
    f" FROM ({bound_sql('static_cb_0')})",
)
def q_hash(spark, sf):
    cb = frame(spark, sf, "static_cb_0").select("case_id", "education_88M")
    return S.hash_string_columns(cb)


@query(
    "fill_null_const",
    with_(**bound("static_0", "static_cb_0"))
    + f" SELECT case_id, {R('coalesce(currdebt_22A, -1)')} AS currdebt_22A, coalesce(education_88M, 'Missing') AS education_88M"
    " FROM static_0 JOIN static_cb_0 USING (case_id)",
)
def q_fill(spark, sf):
    rows = _static(spark, sf).select("case_id", "currdebt_22A").join(frame(spark, sf, "static_cb_0").select("case_id", "education_88M"), "case_id")
    return rounded(S.fill_missing(rows, skip=("case_id",)))


@query("clip01", f"SELECT o_orderkey, {R('least(1.0, greatest(0.0, o_totalprice / 250000 - 0.2))')} AS score FROM orders")
def q_clip(spark, sf):
    return rounded(_orders(spark, sf).select("o_orderkey", S.clip01(F.col("o_totalprice") / 250000 - 0.2).alias("score")))


@query("month_period", "SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS period FROM lineitem")
def q_period(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", S.month_period(F.year("l_shipdate"), F.month("l_shipdate")).alias("period"))


@query("epoch_or_string_to_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_days, CAST(o_orderdate AS DATE) AS from_text FROM orders")
def q_epoch(spark, sf):
    days = F.unix_date(F.col("o_orderdate").cast("date"))
    text = F.col("o_orderdate").cast("date").cast("string")
    rows = _orders(spark, sf).select("o_orderkey", days.alias("days"), text.alias("iso"))
    return rows.select(
        "o_orderkey", F.date_from_unix_date("days").alias("from_days"),
        F.date_from_unix_date(S.day_number(F.col("iso"), rows.schema["iso"].dataType)).alias("from_text"),
    )


@query("week_index", f"SELECT o_orderkey, CAST(floor(({_DAY.format('o_orderdate')} - 10500) / 7.0) AS BIGINT) AS wk FROM orders")
def q_week(spark, sf):
    days = F.unix_date(F.col("o_orderdate").cast("date"))
    return _orders(spark, sf).select("o_orderkey", S.week_index(days, 10500).alias("wk"))


@query(
    "round_list_json",
    "SELECT l_returnflag, '[' || string_agg(CAST(v AS VARCHAR), ',' ORDER BY l_linenumber) || ']' AS rates FROM"
    " (SELECT l_returnflag, l_linenumber, CAST(round(avg(l_quantity), 2) * 100 AS INTEGER) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def q_json(spark, sf):
    per = _lines(spark, sf).groupBy("l_returnflag", "l_linenumber").agg(
        (F.round(F.avg("l_quantity"), 2) * 100).cast("int").alias("v")
    )
    return per.groupBy("l_returnflag").agg(listed_json("l_linenumber", "v").alias("rates"))


@query(
    "log_ratio_sum",
    "WITH c AS (SELECT l_linenumber, sum(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END) AS a,"
    " sum(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END) AS b FROM lineitem GROUP BY 1),"
    " s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)"
    f" SELECT {R('sum((p - q) * ln(p / q))', 8)} AS divergence FROM s",
)
def q_divergence(spark, sf):
    side = lambda s: F.sum((F.col("l_linestatus") == s).cast("double"))
    counts = _lines(spark, sf).groupBy("l_linenumber").agg(side("O").alias("a"), side("F").alias("b"))
    total = counts.agg(F.sum("a"), F.sum("b")).first()
    p, q = F.col("a") / F.lit(total[0]), F.col("b") / F.lit(total[1])
    return rounded(counts.agg(F.sum(S.log_ratio_term(p, q)).alias("divergence")), 8)


_Z = "CASE WHEN currdebt_22A IS NULL THEN 0 ELSE (currdebt_22A - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END END"


@query(
    "standardize_nan0",
    f"{_STATIC}, t AS (SELECT avg(currdebt_22A) AS m, stddev_pop(currdebt_22A) AS s FROM static_0)"
    f" SELECT case_id, {R(_Z)} AS currdebt_22A FROM static_0, t",
)
def q_standard(spark, sf):
    return rounded(standardize_features(_static(spark, sf).select("case_id", "currdebt_22A"), ["currdebt_22A"]))


@query("age_years", f"SELECT o_orderkey, {R(_DAY.format('o_orderdate') + ' / 365.25')} AS age FROM orders")
def q_age(spark, sf):
    days = F.unix_date(F.col("o_orderdate").cast("date"))
    return rounded(_orders(spark, sf).select("o_orderkey", S.age_years(days).alias("age")))


@query("employment_age_ratio", f"SELECT o_orderkey, {R('o_custkey / CAST(' + _DAY.format('o_orderdate') + ' AS DOUBLE)')} AS ratio FROM orders")
def q_employment(spark, sf):
    days = S.to_double(F.unix_date(F.col("o_orderdate").cast("date")))
    worked = S.to_double(F.col("o_custkey").cast("string"))
    return rounded(_orders(spark, sf).select("o_orderkey", S.safe_div(worked, days).alias("ratio")))
