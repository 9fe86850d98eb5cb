"""Scans, sinks and column selection on files that Spark writes from the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evenkeel.functions.scalar import chosen, normalize_dates
from evenkeel.operators import columns as C
from evenkeel.operators.grouping import aggregate_by_key
from evenkeel.operators.models import batch_score
from evenkeel.operators.policies import default_policy
from evenkeel.plans.wide import build_features, date_feature_postprocess, sample_head
from evenkeel.queries.bindings import bound_sql, frame, read, source
from evenkeel.queries.registry import R, agg_sql, bound, group_sql, query, rounded, with_
from evenkeel.session import scratch_path
from evenkeel.sources import files as S
from evenkeel.sources.tables import (
    FrameSource,
    ParquetLayout,
    load_base,
    load_depth0,
    read_typed,
    resolve_group_files,
    scan_group,
    set_table_dtypes,
)


def _write_parts(df, folder, split, group, parts):
    """Numbered part folders named like a table group's files."""
    for i, part in enumerate(parts(df)):
        part.write.parquet(f"{folder}/parquet_files/{split}/{split}_{group}_{i}.parquet")


def _layout(spark, sf):
    """static_0 in three parts with drifting types, and a base, in the file layout."""
    folder = scratch_path(spark, "layout")
    static = frame(spark, sf, "static_0")
    third = F.col("case_id") % 3
    _write_parts(
        static, folder, "train", "static_0",
        lambda df: [
            df.where(third == 0).drop("annuity_780A"),
            df.where(third == 1).withColumn("applicationcnt_361L", F.col("applicationcnt_361L").cast("string")),
            df.where(third == 2).withColumn("case_id", F.col("case_id").cast("int")),
        ],
    )
    frame(spark, sf, "base").write.parquet(f"{folder}/parquet_files/train/train_base.parquet")
    return folder


@query(
    "resolve_group_files",
    f"SELECT CAST(case_id % 3 AS INTEGER) AS part, 'train_static_0_' || (case_id % 3) || '.parquet' AS name, CAST(count(*) AS BIGINT) AS rows"
    f" FROM ({bound_sql('static_0')}) GROUP BY 1, 2",
)
def q_resolve(spark, sf):
    """The files found, in order, with the rows that each holds."""
    out = None
    for part, path in enumerate(resolve_group_files(spark, _layout(spark, sf), "train", "static_0")):
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
        one = one.select(F.lit(part).alias("part"), F.lit(path.rsplit("/", 1)[-1]).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_MONEY = (
    "credamount_770A", "annuitynextmonth_57A", "currdebt_22A", "disbursedcredamount_1113A", "downpmt_116A", "maxannuity_159A",
    "lastapprcredamount_781A", "lastrejectcredamount_222A",
)
_SCAN_SQL = (
    f"SELECT case_id, applicationcnt_361L, strftime(DATE '1970-01-01' + firstclxcampaign_1125D, '%Y-%m-%d') AS firstclxcampaign_1125D, {', '.join(f'{R(c)} AS {c}' for c in _MONEY)}, "
    f"CASE WHEN case_id % 3 <> 0 THEN {R('annuity_780A')} END AS annuity_780A FROM ({bound_sql('static_0')})"
)


@query("scan_group", _SCAN_SQL)
def q_scan(spark, sf):
    return rounded(scan_group(ParquetLayout(spark, _layout(spark, sf), "train"), "static_0"))


@query("load_base", f"SELECT * FROM ({bound_sql('base')})")
def q_load_base(spark, sf):
    return load_base(ParquetLayout(spark, _layout(spark, sf), "train"))


@query(
    "load_depth0",
    "SELECT o_custkey AS case_id, o_orderkey, round(o_totalprice, 4) AS price_1A,"
    " CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS seen_2D FROM orders"
    " QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
)
def q_load_depth0(spark, sf):
    rows = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), "o_orderkey", F.col("o_totalprice").alias("price_1A"),
        F.col("o_orderdate").cast("date").cast("string").alias("seen_2D"),
    )
    return load_depth0(FrameSource({"static_0": rows}, {"static_0": ("o_orderkey",)}), "static_0")


@query(
    "set_table_dtypes",
    "SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) AS num_group1, CAST(l_quantity AS DOUBLE) AS qty_1P,"
    " CAST(l_linenumber AS VARCHAR) AS line_2M, CAST(l_shipdate AS DATE) AS ship_3D FROM lineitem",
)
def q_dtypes(spark, sf):
    raw = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_linenumber").alias("num_group1"),
        F.col("l_quantity").cast("string").alias("qty_1P"), F.col("l_linenumber").alias("line_2M"),
        F.col("l_shipdate").cast("date").cast("string").alias("ship_3D"),
    )
    return set_table_dtypes(raw)


_TYPED_SQL = group_sql(
    "tax_registry_c_1",
    [
        agg_sql("tax_registry_c_1__row_count", "row_count", ""),
        *[agg_sql(f"tax_registry_c_1__pmtamount_36A__{op}", op, "pmtamount_36A") for op in ("mean", "max", "min", "std")],
        *[agg_sql(f"tax_registry_c_1__processingdate_168D__{op}", op, "processingdate_168D") for op in ("mean", "max", "min", "std")],
        agg_sql("tax_registry_c_1__employername_160M__nunique", "nunique", "employername_160M", "raw"),
    ],
)


@query("read_tables", _TYPED_SQL)
def q_read_tables(spark, sf):
    folder = scratch_path(spark, "tables")
    rows = frame(spark, sf, "tax_registry_c_1")
    # Lines of one order land in different files on purpose.
    for i in range(2):
        rows.where(F.col("num_group1") % 2 == i).write.parquet(f"{folder}/train_tax_registry_c_1_{i}.parquet")

    def per_case(df):
        days = normalize_dates(df)
        return aggregate_by_key(days, "case_id", default_policy("tax_registry_c_1", days.schema))

    return rounded(read_typed(spark, f"{folder}/train_tax_registry_c_1_*.parquet", per_case))


def _weeks_file(spark, sf):
    path = scratch_path(spark, "weeks")
    S.write_feature_table(frame(spark, sf, "base"), path, "WEEK_NUM", files=4)
    return path


_WEEK_BASE = "SELECT case_id, MONTH, WEEK_NUM, target FROM base"


@query("write_feature_table", f"{with_(**bound('base'))} {_WEEK_BASE}")
def q_write_features(spark, sf):
    return spark.read.parquet(_weeks_file(spark, sf)).select("case_id", "MONTH", "WEEK_NUM", "target")


@query(
    "feature_cache",
    f"{with_(**bound('base', 'static_0', 'static_cb_0'))} SELECT case_id, target, numberofqueries_373L,"
    f" {R('credamount_770A')} AS credamount_770A FROM base LEFT JOIN static_0 USING (case_id) LEFT JOIN static_cb_0 USING (case_id)",
)
def q_cache(spark, sf):
    cache = S.FeatureCache(scratch_path(spark, "cache"))
    wanted = ["case_id", "numberofqueries_373L", "credamount_770A"]
    build_features(source(spark, sf), "static", "none", wanted, cache=cache)
    return rounded(build_features(source(spark, sf), "static", "none", wanted, cache=cache))


@query("scan_projected", f"{with_(**bound('base'))} SELECT WEEK_NUM FROM base")
def q_projected(spark, sf):
    return S.scan_projected(spark, _weeks_file(spark, sf), ["WEEK_NUM"])


@query("scan_week_range", f"{with_(**bound('base'))} {_WEEK_BASE} WHERE WEEK_NUM BETWEEN 100 AND 140")
def q_week_range(spark, sf):
    out = S.scan_week_range(spark, _weeks_file(spark, sf), "WEEK_NUM", 100, 140)
    return out.select("case_id", "MONTH", "WEEK_NUM", "target")


@query("read_csv_ids", "SELECT o_orderkey AS case_id, round(o_totalprice, 4) AS score FROM orders")
def q_csv_read(spark, sf):
    path = scratch_path(spark, "ids")
    ids = read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("score"))
    S.write_csv(ids, path)
    return S.read_csv(spark, path, "case_id long, score double")


@query("write_scores_csv", f"SELECT o_orderkey AS case_id, {R('o_totalprice / 1000000')} AS score FROM orders")
def q_csv_write(spark, sf):
    path = scratch_path(spark, "scores")
    scores = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") / 1000000).alias("score")
    )
    S.write_csv(rounded(scores), path)
    return S.read_csv(spark, path, "case_id long, score double")


_FOLDS = "CASE WHEN WEEK_NUM < 120 THEN 1 WHEN WEEK_NUM < 240 THEN 2 ELSE 3 END AS fold"


@query("write_oof_parquet", f"{with_(**bound('base'))} SELECT case_id, WEEK_NUM, target, {_FOLDS} FROM base")
def q_oof_write(spark, sf):
    path = scratch_path(spark, "oof")
    oof = frame(spark, sf, "base").select("case_id", "WEEK_NUM", "target", F.expr(_FOLDS.removesuffix(" AS fold")).alias("fold"))
    S.write_oof(oof, path)
    return spark.read.parquet(path)


@query(
    "batch_score_scan",
    "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mid FROM orders) SELECT o_orderkey AS case_id,"
    f" {R('CASE WHEN o_totalprice <= mid THEN 0.8 * (o_totalprice - lo) / (mid - lo) ELSE 0.8 + 0.2 * (o_totalprice - mid) / (hi - mid) END')}"
    " AS score FROM orders, e",
)
def q_batch_score(spark, sf):
    """A numpy model from outside Spark, applied per Arrow batch: a piecewise-linear curve through knots fitted to the table."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_totalprice")
    knots = [float(x) for x in rows.agg(F.min("o_totalprice"), F.avg("o_totalprice"), F.max("o_totalprice")).first()]
    return rounded(batch_score(rows, "case_id", ["o_totalprice"], lambda x: np.interp(x["o_totalprice"], knots, [0.0, 0.8, 1.0])))


# --- projections and selection --------------------------------------------------------------


@query("select_columns", "SELECT o_orderkey, o_custkey FROM orders")
def q_select(spark, sf):
    return C.select_columns(read(spark, sf, "orders"), ["o_orderkey", "absent", "o_custkey"])


_PROJECTED = ["derived__annuity_to_credamount", "applprev_1__annuity_853A__mean", "derived__prev_annuity_mean_to_current"]


@query(
    "output_projection",
    with_(
        **bound("base", "static_0"),
        p=f"SELECT case_id, avg(annuity_853A) AS m FROM ({bound_sql('applprev_1')}) GROUP BY 1",
    )
    + f" SELECT case_id, target, {R('m')} AS applprev_1__annuity_853A__mean,"
    f" CASE WHEN abs(credamount_770A) > 1e-6 THEN {R('annuity_780A / credamount_770A')} END AS derived__annuity_to_credamount,"
    f" CASE WHEN abs(annuity_780A) > 1e-6 THEN {R('m / annuity_780A')} END AS derived__prev_annuity_mean_to_current"
    " FROM base LEFT JOIN static_0 USING (case_id) LEFT JOIN p USING (case_id)",
)
def q_output_projection(spark, sf):
    """Only the wanted outputs; Spark drops every aggregate they do not need."""
    return rounded(build_features(source(spark, sf), "baseline", "ratios", _PROJECTED))


def _static_wide(spark, sf):
    base = normalize_dates(frame(spark, sf, "base")).select("case_id", "target", "WEEK_NUM")
    return base.join(normalize_dates(frame(spark, sf, "static_0")), "case_id", "left").join(
        normalize_dates(frame(spark, sf, "static_cb_0")), "case_id", "left"
    )


_STATIC = with_(**bound("base", "static_0", "static_cb_0"))
_STATIC_JOIN = "FROM base LEFT JOIN static_0 USING (case_id) LEFT JOIN static_cb_0 USING (case_id)"
_KEEP = ["credamount_770A", "annuity_780A", "annuitynextmonth_57A", "disbursedcredamount_1113A", "downpmt_116A", "maxannuity_159A", "lastapprcredamount_781A"]
_KEEP_SQL = ", ".join(f"{R(c)} AS {c}" for c in _KEEP)


@query(
    "filter_columns_by_profile",
    f"{_STATIC} SELECT case_id, target, WEEK_NUM, {_KEEP_SQL}, applicationcnt_361L, firstclxcampaign_1125D,"
    f" numberofqueries_373L, {R('pmtssum_45A')} AS pmtssum_45A, responsedate_1012D {_STATIC_JOIN}",
)
def q_filter_profile(spark, sf):
    """Sparse columns (more than half null) and text with over four values are dropped."""
    return rounded(C.filter_columns_by_profile(_static_wide(spark, sf), 0.5, 4)[0])


@query(
    "filter_cols_strict",
    f"{_STATIC} SELECT case_id, target, WEEK_NUM, {_KEEP_SQL}, applicationcnt_361L, firstclxcampaign_1125D,"
    f" numberofqueries_373L, {R('pmtssum_45A')} AS pmtssum_45A, responsedate_1012D, education_88M {_STATIC_JOIN}",
)
def q_filter_strict(spark, sf):
    wide = _static_wide(spark, sf).withColumn("month_of_week", F.col("WEEK_NUM") % 12)
    return rounded(C.filter_cols_strict(wide, 0.6, 50))


@query("drop_by_prefix_or_agg", f"{_STATIC} SELECT case_id, target, WEEK_NUM, {R('credamount_770A')} AS a__x__max {_STATIC_JOIN}")
def q_drop_prefix(spark, sf):
    wide = _static_wide(spark, sf).select(
        "case_id", "target", "WEEK_NUM", F.col("credamount_770A").alias("a__x__max"),
        F.col("annuity_780A").alias("a__x__sum"), F.col("downpmt_116A").alias("b__y__max"),
    )
    return rounded(C.drop_by_prefix_or_agg(wide, ["b__"], ["sum"])[0])


@query("apply_drop_list", f"{_STATIC} SELECT case_id, target, {R('credamount_770A')} AS credamount_770A {_STATIC_JOIN}")
def q_drop_list(spark, sf):
    path = scratch_path(spark, "drops") + ".csv"
    names = [("annuity_780A",), ("case_id",), ("not_there",)]
    S.write_csv(spark.createDataFrame(names, "feature string"), path)
    wide = _static_wide(spark, sf).select("case_id", "target", "credamount_770A", "annuity_780A")
    return rounded(C.apply_drop_list(wide, S.read_drop_list(spark, path)))


@query("date_feature_postprocess", f"{_STATIC} SELECT case_id, target, WEEK_NUM,"
    " CAST(firstclxcampaign_1125D - date_decision AS DOUBLE) AS firstclxcampaign_1125D,"
    " CAST(responsedate_1012D - date_decision AS DOUBLE) AS responsedate_1012D,"
    f" CAST(applicationcnt_361L AS BIGINT) AS month_paid_1L {_STATIC_JOIN}")
def q_postprocess(spark, sf):
    base = normalize_dates(frame(spark, sf, "base"))
    wide = base.join(_static_wide(spark, sf).drop("target", "WEEK_NUM"), "case_id", "left").select(
        "case_id", "target", "WEEK_NUM", "MONTH", "date_decision", "firstclxcampaign_1125D", "responsedate_1012D",
        F.col("applicationcnt_361L").alias("month_paid_1L"), F.col("applicationcnt_361L").alias("month_paid_1T"),
    )
    return date_feature_postprocess(wide)


@query("sample_head", "SELECT o_orderkey AS case_id, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500")
def q_sample_head(spark, sf):
    return sample_head(read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey"), 500, "case_id")


@query(
    "sample_random",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY ('0x' || md5(CAST(o_orderkey AS VARCHAR) || ':42')[1:12])::BIGINT, o_orderkey LIMIT 500",
)
def q_sample_random(spark, sf):
    return C.sample_random(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 500, "o_orderkey")


@query(
    "narrow_types",
    "SELECT l_orderkey AS case_id, CAST(l_linenumber AS TINYINT) AS l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity,"
    " CAST(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS TINYINT) AS cheap FROM lineitem",
)
def q_narrow(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_quantity", (F.col("l_discount") > 0.05).alias("cheap")
    )
    return C.narrow_types(rows)


@query("align_columns", "SELECT o_custkey, CAST(NULL AS DOUBLE) AS absent, o_orderkey FROM orders")
def q_align(spark, sf):
    return C.align_columns(read(spark, sf, "orders"), ["o_custkey", "absent", "o_orderkey"])


@query(
    "candidate_features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature FROM lineitem HAVING count(DISTINCT {c}) > 1"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def q_candidates(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("l_constant", F.lit(1))
    found = C.candidate_features(rows.drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ["l_"])
    return spark.createDataFrame([(f,) for f in found], "feature string")


@query(
    "case_filter_expr",
    "SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS many,"
    f" {R('max(CASE WHEN l_returnflag IS NOT NULL AND abs(l_tax) > 1e-6 THEN l_extendedprice / l_tax END)')} AS per_tax"
    " FROM lineitem GROUP BY 1",
)
def q_case(spark, sf):
    per_tax = chosen(F.col("l_returnflag").isNotNull() & (F.abs("l_tax") > 1e-6), F.col("l_extendedprice") / F.col("l_tax"))
    many = chosen(F.col("l_quantity") > 25)
    return rounded(read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(many).alias("many"), F.max(per_tax).alias("per_tax")))
