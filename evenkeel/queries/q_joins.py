"""Joins, unions and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.scalar import normalize_dates
from evenkeel.operators import joins as J
from evenkeel.operators.blend import expand_weights, restore_week_signal, weight_grid
from evenkeel.operators.hierarchy import aggregate_large_lite
from evenkeel.operators.policies import default_policy
from evenkeel.operators.grouping import aggregate_by_key
from evenkeel.plans.validate import fold_windows, max_week, union_folds
from evenkeel.plans.wide import decision_dates
from evenkeel.queries.bindings import bound_sql, frame, read
from evenkeel.queries.registry import R, agg_sql, bound, query, rounded, with_

_4 = ("mean", "max", "min", "std")
_LINE_CELLS = ", ".join(
    [
        agg_sql("applprev_1__row_count", "row_count", ""),
        *[agg_sql(f"applprev_1__annuity_853A__{op}", op, "annuity_853A") for op in _4],
    ]
)


@query(
    "wide_left_join",
    with_(
        **bound("base", "static_0"),
        p=f"SELECT case_id, {_LINE_CELLS}, max(annuity_853A) AS credamount_770A FROM ({bound_sql('applprev_1')}) GROUP BY 1",
    )
    + f" SELECT b.case_id, b.date_decision, b.MONTH, b.WEEK_NUM, b.target, {R('s.credamount_770A')} AS credamount_770A,"
    f" {R('s.annuity_780A')} AS annuity_780A, p.* EXCLUDE (case_id, credamount_770A), {R('p.credamount_770A')} AS credamount_770A_1"
    " FROM base b LEFT JOIN static_0 s USING (case_id) LEFT JOIN p USING (case_id)",
)
def q_wide(spark, sf):
    """Base, a depth-0 table and an aggregated child with a clashing column name."""
    base = normalize_dates(frame(spark, sf, "base"))
    static = frame(spark, sf, "static_0").select("case_id", "credamount_770A", "annuity_780A")
    lines = frame(spark, sf, "applprev_1").select("case_id", "annuity_853A")
    child = aggregate_by_key(lines, "case_id", default_policy("applprev_1", lines.schema))
    child = child.withColumn("credamount_770A", F.col("applprev_1__annuity_853A__max"))
    return rounded(J.wide_left_join(base, [static, child], "case_id", numbered_from=0))


@query(
    "semi_filter_cases",
    "SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity FROM lineitem"
    " WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
)
def q_semi(spark, sf):
    ids = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return J.semi_filter(lines, ids, "l_orderkey")


@query(
    "attach_decision_date",
    f"{with_(**bound('base', 'deposit_1'))} SELECT case_id, num_group1, openingdate_313D,"
    " CAST(date_decision AS DOUBLE) AS __decision_date FROM deposit_1 LEFT JOIN base USING (case_id)",
)
def q_decision(spark, sf):
    events = normalize_dates(frame(spark, sf, "deposit_1")).select("case_id", "num_group1", "openingdate_313D")
    return J.attach_decision_date(events, decision_dates(normalize_dates(frame(spark, sf, "base"))), "case_id")


@query(
    "join_large_group",
    with_(
        **bound("base"),
        a=f"SELECT case_id, CAST(count(*) AS BIGINT) AS n, {R('avg(pmts_overdue_1140A)')} AS m"
        f" FROM ({bound_sql('credit_bureau_a_2')}) GROUP BY 1",
    )
    + " SELECT case_id, target, n AS credit_bureau_a_2__row_count, m AS credit_bureau_a_2__pmts_overdue_1140A__mean"
    " FROM base LEFT JOIN a USING (case_id)",
)
def q_large(spark, sf):
    lite = aggregate_large_lite(frame(spark, sf, "credit_bureau_a_2"), "credit_bureau_a_2")
    wide = J.left_join_on_key(frame(spark, sf, "base"), lite, "case_id")
    return rounded(
        wide.select("case_id", "target", "credit_bureau_a_2__row_count", "credit_bureau_a_2__pmts_overdue_1140A__mean")
    )


_SCORE = "o_totalprice / 1000000"


def _scores(spark, sf, where="o_orderstatus <> 'P'"):
    rows = read(spark, sf, "orders").where(where)
    return rows.select(F.col("o_orderkey").alias("case_id"), F.expr(_SCORE).alias("score"))


@query(
    "align_to_ids",
    f"WITH s AS (SELECT o_orderkey AS case_id, {_SCORE} AS score FROM orders WHERE o_orderstatus <> 'P')"
    f" SELECT o_orderkey AS case_id, {R('coalesce(score, (SELECT avg(score) FROM s))')} AS score"
    " FROM orders LEFT JOIN s ON o_orderkey = case_id",
)
def q_align(spark, sf):
    ids = read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    return rounded(J.align_to_ids(ids, _scores(spark, sf), "case_id"))


@query(
    "join_time_signal",
    f"{with_(**bound('base'))} SELECT o_orderkey AS case_id, {R(_SCORE)} AS score, CAST(WEEK_NUM AS DOUBLE) AS time_signal"
    " FROM orders LEFT JOIN base ON o_orderkey = base.case_id",
)
def q_signal(spark, sf):
    signal = restore_week_signal(frame(spark, sf, "base"), None)
    return rounded(_scores(spark, sf, "true").join(signal, "case_id", "left"))


@query(
    "join_branch_scores",
    "WITH c AS (SELECT o_orderkey AS case_id, o_custkey / 1000.0 AS cat FROM orders WHERE o_orderstatus <> 'O')"
    f" SELECT o_orderkey AS case_id, {R(_SCORE)} AS score, {R('coalesce(cat, (SELECT avg(cat) FROM c))')} AS cat"
    " FROM orders LEFT JOIN c ON o_orderkey = case_id",
)
def q_branches(spark, sf):
    cat = read(spark, sf, "orders").where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") / F.lit(1000.0)).alias("cat")
    )
    return rounded(J.join_branch_scores(_scores(spark, sf, "true"), [cat], "case_id"))


@query(
    "merge_reports",
    f"WITH a AS (SELECT o_orderpriority AS feature, {R('sum(o_totalprice)', 1)} AS gain FROM orders GROUP BY 1),"
    f" b AS (SELECT o_orderpriority AS feature, {R('avg(o_totalprice)')} AS iv FROM orders WHERE o_orderstatus = 'F'"
    " AND o_orderpriority < '4' GROUP BY 1) SELECT feature, gain, iv FROM a LEFT JOIN b USING (feature)",
)
def q_merge(spark, sf):
    orders = read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "feature")
    gain = orders.groupBy("feature").agg(F.sum("o_totalprice").alias("gain"))
    report = orders.where("o_orderstatus = 'F' AND feature < '4'").groupBy("feature").agg(F.avg("o_totalprice").alias("iv"))
    merged = J.merge_reports(rounded(gain, 1), rounded(report), ["iv", "psi"])
    return merged


@query(
    "fold_range_assign",
    f"{with_(**bound('base'))}, m AS (SELECT max(WEEK_NUM) AS top FROM base),"
    " f AS (SELECT CAST(5 - i AS INTEGER) AS fold, top - 20 * i - 19 AS lo, top - 20 * i AS hi FROM m, range(5) t(i))"
    " SELECT case_id, WEEK_NUM, fold, CASE WHEN WEEK_NUM < lo THEN 'train' ELSE 'valid' END AS role"
    " FROM base JOIN f ON WEEK_NUM <= hi",
)
def q_folds(spark, sf):
    base = frame(spark, sf, "base").select("case_id", "WEEK_NUM")
    return J.assign_fold_ranges(base, fold_windows(max_week(base), 20, 5))


@query(
    "weight_grid_cross",
    "WITH t AS (SELECT i FROM range(21) r(i)), g AS (SELECT a.i / 20.0 AS a_weight, b.i / 20.0 AS b_weight,"
    " (20 - a.i - b.i) / 20.0 AS c_weight FROM t a, t b WHERE 20 - a.i - b.i BETWEEN 0 AND 6)"
    f" SELECT {R('a_weight')} AS a_weight, {R('b_weight')} AS b_weight, {R('c_weight')} AS c_weight, CAST(count(*) AS BIGINT) AS n,"
    f" {R('avg(a_weight * o_totalprice / 1000000 + b_weight * o_custkey / 100000 + c_weight * 0.5)')} AS mean_score"
    " FROM g, orders GROUP BY a_weight, b_weight, c_weight",
)
def q_grid(spark, sf):
    rows = read(spark, sf, "orders").select(
        (F.col("o_totalprice") / 1000000).alias("a"), (F.col("o_custkey") / 100000).alias("b"), F.lit(0.5).alias("c")
    )
    spread = expand_weights(rows, ["a", "b", "c"], weight_grid())
    score = F.expr("a_weight * a + b_weight * b + c_weight * c")
    return rounded(
        spread.groupBy("a_weight", "b_weight", "c_weight").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    )


@query(
    "lookup_map",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS code FROM orders",
)
def q_map(spark, sf):
    return read(spark, sf, "orders").select(
        "o_orderkey", J.map_values(F.col("o_orderstatus"), {"F": 0, "O": 1}, -1).alias("code")
    )


@query(
    "concat_columns",
    "SELECT o_orderkey, length(o_orderstatus) AS a, CAST(o_custkey % 5 AS BIGINT) AS b FROM orders".replace(
        "length(o_orderstatus)", "CAST(length(o_orderstatus) AS INTEGER)"
    ),
)
def q_concat(spark, sf):
    rows = read(spark, sf, "orders")
    return J.concat_columns(rows, {"a": F.length("o_orderstatus"), "b": F.col("o_custkey") % 5}).select("o_orderkey", "a", "b")


@query(
    "union_relaxed",
    "SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F'"
    " UNION ALL SELECT o_totalprice, NULL FROM orders WHERE o_orderstatus <> 'F'",
)
def q_union(spark, sf):
    rows = read(spark, sf, "orders")
    a = rows.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("int").alias("k"), F.col("o_orderstatus").alias("s"))
    b = rows.where("o_orderstatus <> 'F'").select(F.col("o_totalprice").alias("k"))
    return J.union_relaxed([a, b])


@query(
    "union_folds",
    f"{with_(**bound('base'))} SELECT case_id, CASE WHEN WEEK_NUM < 100 THEN 1 ELSE 2 END AS fold FROM base",
)
def q_union_folds(spark, sf):
    base = frame(spark, sf, "base")
    return union_folds(
        [
            base.where("WEEK_NUM < 100").select("case_id", F.lit(1).alias("fold")),
            base.where("WEEK_NUM >= 100").select("case_id", F.lit(2).alias("fold")),
        ]
    )


_LAST = (
    "SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders"
    " QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {}) = 1"
)


@query("dedup_keep_last", _LAST.format("o_orderdate DESC, o_orderkey DESC"))
def q_keep_last(spark, sf):
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return J.keep_last(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("distinct_by_key", _LAST.format("o_orderkey DESC"))
def q_distinct(spark, sf):
    return J.distinct_by_key(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), "o_custkey")
