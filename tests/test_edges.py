"""Null, tie, empty and single-row cases; skew paths forced by tiny limits."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evenkeel import fixed
from evenkeel.functions import scalar as S
from evenkeel.functions.aggregates import Measure
from evenkeel.functions.naming import DEFAULT
from evenkeel.operators import blend, encode, lab, metrics, ordering, policies
from evenkeel.operators.columns import choose_columns, drop_by_prefix_or_agg
from evenkeel.operators.derived import derive, derived_output_columns
from evenkeel.operators.grouping import aggregate_by_key, group_medians
from evenkeel.operators.hierarchy import aggregate_two_stage
from evenkeel.operators.joins import keep_last, left_join_on_key, semi_filter, union_relaxed
from evenkeel.operators.profile import duplicate_columns, profile_columns
from evenkeel.operators.skew import lookup_join
from evenkeel.plans import presets
from evenkeel.plans.validate import assign_balanced, fold_windows
from evenkeel.plans.wide import build_features
from evenkeel.queries.bindings import CUSTOMERS, frame, source
from evenkeel.sources.tables import FrameSource, ParquetLayout, load_depth0, scan_group

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def child(spark, data):
    return spark.createDataFrame(data, "case_id long, num_group1 long, x_1A double, s_2M string")


CHILD = [
    (1, 0, None, "a"), (1, 1, 5.0, None), (1, 2, 3.0, "b"),
    (2, 0, None, None), (2, 1, None, None),
    (3, 7, 4.0, "z"),
]


def test_aggregate_null_rules(spark):
    ops = ("sum", "std", "gap", "first", "last", "median", "count")
    ms = [Measure(op, op, "x_1A") for op in ops] + [
        Measure("n", "row_count"), Measure("d", "nunique", "s_2M", "raw"),
        Measure("sf", "first", "s_2M", "raw"), Measure("sl", "last", "s_2M", "raw"),
    ]
    got = {r["case_id"]: r for r in aggregate_by_key(child(spark, CHILD), "case_id", ms, ("num_group1",)).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["sum"], one["first"], one["last"], one["median"], one["gap"], one["count"]) == (8.0, None, 3.0, 4.0, 2.0, 2)
    assert (two["sum"], two["std"], two["gap"], two["median"], two["d"], two["n"]) == (0.0, None, None, None, 1, 2)
    assert (three["std"], three["gap"], three["first"], three["last"]) == (None, 0.0, 4.0, 4.0)
    assert (one["d"], one["sf"], one["sl"]) == (3, "a", "b")


def test_first_last_need_order(spark):
    with pytest.raises(ValueError):
        aggregate_by_key(child(spark, CHILD), "case_id", [Measure("f", "first", "x_1A")])
    with pytest.raises(ValueError):
        aggregate_by_key(child(spark, CHILD), "case_id", [Measure("f", "mode", "x_1A")])


def test_dates_before_decision_are_worked_out_after_grouping(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, None), (1, 2, 40)], "case_id long, num_group1 long, d_1D int")
    decisions = spark.createDataFrame([(1, 100.0)], "case_id long, __decision_date double")
    ms = [Measure(op, op, "d_1D", "before") for op in ("max", "min", "mean", "std", "sum", "median", "first", "last", "gap")]
    got = aggregate_by_key(df, "case_id", ms, ("num_group1",), decisions).first()
    values = [90.0, 60.0]
    assert (got["max"], got["min"], got["mean"], got["sum"], got["median"]) == (90.0, 60.0, 75.0, 150.0, 75.0)
    assert (got["first"], got["last"], got["gap"]) == (90.0, 60.0, 30.0)
    assert got["std"] == pytest.approx(statistics.stdev(values))


def test_hot_keys_give_the_same_medians(spark):
    rng = random.Random(3)
    data = [(k, rng.choice([None, *map(float, range(50))]), rng.random()) for k in (1, 2, 3) for _ in range({1: 300, 2: 40, 3: 1}[k])]
    data += [(4, None, None)] * 80
    df = spark.createDataFrame(data, "k long, a double, b double")
    cols = {"ma": F.col("a"), "mb": F.col("b")}
    plain = rows(group_medians(df, "k", cols))
    split = rows(group_medians(df, "k", cols, hot_rows=30))
    assert [r[0] for r in split] == [1, 2, 3, 4]
    for p, s in zip(plain, split):
        assert p == pytest.approx(s)


def test_quantiles_match_brute_force(spark):
    rng = random.Random(5)
    # A third of the values is one number.
    data = [(i, 7.0 if i % 3 == 0 else rng.gauss(0, 10), None if i % 5 else float(i)) for i in range(997)]
    df = spark.createDataFrame(data, "i long, a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["feature"], r["i"]): r["q"] for r in ordering.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, probs, buckets=16).collect()}
    for name, col in (("a", 1), ("b", 2)):
        xs = sorted(r[col] for r in data if r[col] is not None)
        for i, p in enumerate(probs):
            pos = p * (len(xs) - 1)
            lo, hi = xs[math.floor(pos)], xs[math.ceil(pos)]
            assert got[(name, i)] == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))


def test_rank_first_with_a_hot_value(spark):
    rng = random.Random(9)
    data = [(i, 1.0 if rng.random() < 0.5 else float(rng.randrange(40))) for i in range(600)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, x double")
    got = {r["id"]: r["r"] for r in ordering.rank_first(df, ["x"], "id", buckets=32).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(data, key=lambda t: (t[1], t[0])), start=1)}
    assert got == want


def test_auc_with_ties_and_any_bucket_count(spark):
    rng = random.Random(1)
    data = [(rng.randrange(2), rng.randrange(12) / 12, rng.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame(data, "target int, score double, WEEK_NUM int")
    pos = [s for t, s, _ in data if t]
    neg = [s for t, s, _ in data if not t]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for buckets in (1, 3, 64):
        assert metrics.auc(df, "score", buckets=buckets).first()["auc"] == pytest.approx(want)


def test_stability_edge_cases(spark):
    make = lambda d: spark.createDataFrame(d, "target int, score double, WEEK_NUM int")
    one_week = metrics.stability_metric(make([(0, 0.1, 1), (1, 0.9, 1), (1, 0.5, 2)]), "score").first()
    assert math.isnan(one_week["stability"]) and one_week["n_weeks"] == 1.0
    level = [(t, s, w) for w in range(4) for t, s in ((0, 0.1), (1, 0.9))]
    flat = metrics.stability_metric(make(level), "score").first()
    assert (flat["stability"], flat["falling_rate"], flat["n_weeks"]) == (1.0, 0.0, 4.0)


def test_fold_windows():
    assert fold_windows(91, 20, 5) == [(12, 31), (32, 51), (52, 71), (72, 91)]
    assert fold_windows(91, 20, 2, 3) == [(49, 68), (72, 91)]
    assert fold_windows(10, 20, 5) == []


def test_column_family_order():
    families = {
        "dateofcredstart_181D": "amount", "numberofoverdueinstlmaxdat_148D": "delinquency",
        "annualeffectiverate_199L": "count_term", "interestrate_1T": "rate", "birth_259D": "date", "sex_738M": "other",
        "xyz_1P": "delinquency",
    }
    assert {c: DEFAULT.family(c) for c in families} == families


def test_feature_sets_and_presets():
    assert presets.parse_feature_set("none") == frozenset()
    assert presets.parse_feature_set("light1") == {"missing", "counts", "ratios", "ranges"}
    with pytest.raises(ValueError, match="no feature component"):
        presets.parse_feature_set("ratios+nope")
    with pytest.raises(ValueError, match="no preset"):
        presets.preset("nope")
    assert len(presets.PRESETS) == 9
    assert presets.uses_custom(frozenset({"custom_tax_aggs"}), "tax_registry_b_1")
    assert not presets.uses_custom(frozenset({"custom_tax_aggs"}), "person_1")


def test_narrow_rules():
    from pyspark.sql import types as T

    narrow = frozenset({"custom_person_narrow_aggs", "custom_bureau_a1_narrow_aggs", "custom_applprev_narrow_aggs"})
    ops = policies.custom_numeric_ops
    d = T.DoubleType()
    assert ops("person_1", "mainincome_1A", d) == ("max", "first", "last")
    assert ops("person_1", "mainincome_1A", d, narrow) == ("max",)
    assert ops("person_1", "birth_259D", d) == ("first", "last", "max", "min")
    assert ops("credit_bureau_a_1", "dpdmax_139P", d, narrow) == ("max", "mean", "std")
    assert ops("applprev_2", "cards_1L", d) == ("first", "last", "nunique")
    assert ops("applprev_1", "flag_1L", T.BooleanType()) == ("max", "last")
    assert ops("elsewhere", "a_1A", d) == ("max", "min")
    assert policies.custom_text_ops("applprev_1", narrow) == ("nunique",)
    assert policies.custom_text_ops("deposit_1") == ("first", "last", "nunique")


def test_scalar_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -1.0), (1.0, 1e-9), (1.0, None), (1.0, 2.0)], "a double, b double")
    got = df.select(S.safe_div(F.col("a"), F.col("b")), S.safe_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [None, None, pytest.approx(1e9), None, 0.5]
    assert [r[1] for r in got] == [None, -1.0, None, None, 0.5]


def test_dates(spark):
    df = spark.createDataFrame([("2019-01-03",), ("2019-01",), ("junk text",), (None,)], "a_1D string")
    assert [r[0] for r in S.normalize_dates(df).collect()] == [17899, None, None, None]
    same = spark.createDataFrame([(5,)], "a_1D int")
    assert S.normalize_dates(same).first()[0] == 5


def test_hash_string(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "s string")
    a, n, b = [r[0] for r in S.hash_string_columns(df).collect()]
    assert n == -1 and a == b and 0 <= a < S.HASH_MODULUS


def test_scan_reconciles_types(spark, tmp_path):
    folder = f"{tmp_path}/parquet_files/train"
    spark.createDataFrame([(1, 5, None)], "case_id int, v int, n void").select("case_id", "v").write.parquet(f"{folder}/train_t_1_0.parquet")
    spark.createDataFrame([(2, "x", "y"), (3, "7", None)], "case_id long, v string, w string").write.parquet(f"{folder}/train_t_1_1.parquet")
    df = scan_group(ParquetLayout(spark, str(tmp_path), "train"), "t_1")
    assert dict(df.dtypes) == {"case_id": "bigint", "v": "int", "w": "string"}
    assert rows(df) == [(1, 5, None), (2, None, "y"), (3, 7, None)]
    with pytest.raises(FileNotFoundError):
        scan_group(ParquetLayout(spark, str(tmp_path), "train"), "absent")


def test_depth0_keeps_the_last_file(spark, tmp_path):
    folder = f"{tmp_path}/parquet_files/train"
    for i, v in enumerate((10, 20)):
        spark.createDataFrame([(1, v), (2 + i, v)], "case_id long, v int").coalesce(1).write.parquet(f"{folder}/train_static_0_{i}.parquet")
    df = load_depth0(ParquetLayout(spark, str(tmp_path), "train"), "static_0")
    assert rows(df) == [(1, 20), (2, 10), (3, 20)]


def test_two_stage_is_file_split_invariant(spark):
    df = frame(spark, SF, "credit_bureau_a_2", "customers")
    parts = [df.where(F.pmod(F.xxhash64("num_group1", "num_group2"), F.lit(3)) == i) for i in range(3)]
    whole = aggregate_two_stage(df, "credit_bureau_a_2")
    split = aggregate_two_stage(parts[2].unionByName(parts[0]).unionByName(parts[1]), "credit_bureau_a_2")
    names = [c for c in whole.columns if "mean" not in c and "std" not in c and "__sum" not in c]
    assert rows(whole.select(names)) == rows(split.select(names))
    assert len(CUSTOMERS) == 1


def test_thresholds_are_strict(spark):
    names = ["case_id", "num_group1", "num_group2", *fixed.LARGE_COLUMNS["credit_bureau_a_2"]]
    kinds = ["long"] * 3 + ["double"] * 8
    data = [(1, 1, i, d, None, None, None, 5.0, None, 2020.0, None) for i, d in enumerate((0.0, 30.0, 31.0, 60.0, 91.0))]
    df = spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    got = aggregate_two_stage(df, "credit_bureau_a_2").first().asDict()
    g = "credit_bureau_a_2__"
    assert [got[f"{g}dpd_gt{n}_payment_count"] for n in (0, 30, 60, 90)] == [4, 3, 1, 1]
    assert (got[f"{g}active_payment_count"], got[f"{g}closed_payment_count"], got[f"{g}has_closed_payment"]) == (5, 0, 0)
    assert got[f"{g}pmts_overdue_1140A__sum"] == 0.0 and got[f"{g}pmts_overdue_1140A__mean"] is None


def test_derived_names_equal_static_list(spark):
    """With every input present the produced columns are the listed ones."""
    feature_set = "ratios+ranges_stable+a2_twostage+a2_delinquency+a2_payment_mix+a2_temporal+semantic_v2"
    listed = derived_output_columns(feature_set)
    from evenkeel.operators.derived import component_formulas

    inputs = {c for f in component_formulas(presets.parse_feature_set(feature_set), []) for s in f.inputs for c in s}
    wide = spark.range(1).select(F.col("id").alias("case_id"), *[F.lit(1.0).alias(c) for c in sorted(inputs)])
    made = [c for c in derive(wide, feature_set).columns if c not in wide.columns]
    assert set(made) == {c for c in listed if c not in inputs and not c.startswith("credit_bureau_a_2__")}
    assert len(listed) == len(set(listed))


def test_join_collisions(spark):
    a = spark.createDataFrame([(1, 2)], "k long, v int")
    assert left_join_on_key(a, a, "k").columns == ["k", "v", "v_right"]
    with pytest.raises(ValueError):
        left_join_on_key(left_join_on_key(a, a, "k"), a, "k")


def test_lookup_survives_hot_and_null_keys(spark):
    data = [("hot", i) for i in range(60)] + [(None, 1), ("cold", 2), ("unseen", 3)]
    df = spark.createDataFrame(data, "k string, i int")
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    small = rows(lookup_join(df, table, "k"), "k", "i")
    assert rows(lookup_join(df, table, "k", max_rows=0, hot_rows=10), "k", "i") == small
    assert rows(lookup_join(df, table, "k", max_rows=0), "k", "i") == small
    assert semi_filter(df, table, "k", max_rows=0).count() == 61


def test_keep_last_and_union(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 5, "c")], "k long, o int, v string")
    assert rows(keep_last(df, "k", ["o"])) == [(1, 2, None), (2, 5, "c")]
    out = union_relaxed([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2.5, "x")], "a double, b string")])
    assert dict(out.dtypes) == {"a": "double", "b": "string"} and out.count() == 2


def test_selection_reasons(spark):
    data = [(i, 1, None if i else 1.0, 5.0, f"t{i}", "s" if i % 2 else None) for i in range(20)]
    df = spark.createDataFrame(data, "case_id long, target int, empty double, fixed double, many string, few string")
    chosen = choose_columns(df, 0.9, 10)
    assert chosen.dropped == {"missing": ["empty"], "constant": ["fixed"], "high_cardinality": ["many"]}
    assert chosen.kept == ["case_id", "target", "few"]
    exact = profile_columns(df.select("fixed", "many"))
    assert (exact["fixed"].distinct, exact["many"].distinct) == (1, 20)
    kept, dropped = drop_by_prefix_or_agg(df.select("case_id", F.lit(1).alias("p__x__max"), F.lit(1).alias("q__sum")), ["p__"], ["sum"])
    assert kept.columns == ["case_id"] and dropped == {"prefix": ["p__x__max"], "agg": ["q__sum"]}


def test_duplicates_need_the_same_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 1.0), (2, 2.0, 1.0, 2.0)], "k long, a double, permuted double, copy double")
    assert duplicate_columns(df, ["a", "permuted", "copy"], "k") == [("copy", "a")]


def test_preprocessor_state_round_trip(spark):
    data = [(i, i % 2, i, None if i % 3 else float(i), "b" if i % 2 else "a", 1.0) for i in range(12)]
    df = spark.createDataFrame(data, "case_id long, target int, WEEK_NUM int, gappy double, cat string, fixed double")
    state = encode.fit_preprocessor(df, missing_indicator_min_rate=0.5)
    assert state.dropped_columns["constant"] == ["fixed"]
    assert encode.PreprocessState.from_json(state.to_json()) == state
    assert state.fill_values["gappy"] == 4.5 and state.category_maps == {"cat": ["a", "b"]}
    unseen = spark.createDataFrame([(1, None, "zzz"), (2, 3.0, None)], "case_id long, gappy double, cat string")
    got = rows(encode.apply_preprocessor(unseen, state, ("case_id",)).select("case_id", "gappy", "cat", "gappy__is_missing"))
    assert got == [(1, 4.5, -1, 1), (2, 3.0, -1, 0)]


def test_count_encoding_of_null_and_unseen(spark):
    fit = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    new = spark.createDataFrame([(1, "a"), (2, "q"), (3, None)], "i int, s string")
    assert [r["s_cnt"] for r in encode.count_encode(new, ["s"], fit).orderBy("i").collect()] == [2, -1, -2]


def test_psi_is_zero_when_undefined(spark):
    few = spark.createDataFrame([(float(i), i % 3) for i in range(30)], "x double, WEEK_NUM int")
    assert lab.psi_by_time(few, ["x"]).first()["psi"] == 0.0
    flat = spark.createDataFrame([(1.0, i) for i in range(10)], "x double, WEEK_NUM int")
    assert lab.psi_by_time(flat, ["x"]).first()["psi"] == 0.0


def test_score_shift_is_off_by_default(spark):
    scores = spark.createDataFrame([(1, 0.01), (2, 0.5)], "case_id long, score double")
    signal = spark.createDataFrame([(1, 0.0), (2, 10.0)], "case_id long, time_signal double")
    same, summary = blend.time_split_score_shift(scores, signal)
    assert rows(same) == [(1, 0.01), (2, 0.5)] and summary == {"enabled": False}
    moved, summary = blend.time_split_score_shift(scores, signal, enabled=True)
    assert rows(moved) == [(1, 0.0), (2, 0.5)] and summary["adjusted_rows"] == 1


def test_weight_grid():
    grid = blend.weight_grid(0.05, 0.30)
    assert all(abs(sum(w) - 1) < 1e-9 and w[2] <= 0.3 + 1e-9 for w in grid) and len(grid) == len(set(grid))


def test_balanced_folds_keep_every_week():
    counts = {w: (50 + w, 5 + w % 4) for w in range(30)}
    chosen = assign_balanced(counts, 5)
    assert set(chosen) == set(counts) and set(chosen.values()) == set(range(5))


def test_build_is_one_row_per_case(spark):
    src = source(spark, SF)
    wide = build_features(src, "sota_cat", "sota_cat_661", sample_rows=200)
    assert wide.count() == wide.select("case_id").distinct().count() == 200
    assert "date_decision" not in wide.columns and "decision_weekday" in wide.columns
    # Text is hashed before the payment-level group joins.
    assert all(t != "string" for c, t in wide.dtypes if not c.startswith("credit_bureau_a_2__"))


def test_build_prefixed_and_full_sets(spark):
    src = source(spark, SF)
    wide = build_features(src, "sota_lgb", "sota_lgb_644", sample_rows=50)
    assert {"max_depth2_pmts_dpd_1073P", "mainoccupationinc_384A_max", "WEEK_NUM"} <= set(wide.columns)
    everything = build_features(src, "a2lite", "ex2_data+a2_twostage+a2_delinquency+semantic_v2+missing+counts", sample_rows=50)
    assert everything.count() == 50 and "derived__a2_max_dpd" in everything.columns


def test_frame_source_errors(spark):
    with pytest.raises(FileNotFoundError):
        FrameSource({}).table("base")


def test_correlation_prune_keeps_the_richest_of_a_group(spark):
    data = [(float(i), float(2 * i), float(i // 4), float(i % 3), None if i == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(data, "a double, b double, coarse double, free double, gap double")
    assert encode.correlation_prune(df, ["coarse", "a", "b", "free", "gap"]) == ["a", "free", "gap"]


def test_large_groups_see_all_files_at_once(spark, tmp_path):
    """A case whose payments lie in two files is whole."""
    folder = f"{tmp_path}/parquet_files/train"
    df = frame(spark, SF, "credit_bureau_a_2")
    for i in range(2):
        df.where(F.pmod("num_group2", F.lit(2)) == i).write.parquet(f"{folder}/train_credit_bureau_a_2_{i}.parquet")
    from evenkeel.plans.wide import aggregate_large

    split = aggregate_large(ParquetLayout(spark, str(tmp_path), "train"), "credit_bureau_a_2", "sota_cat_661")
    whole = aggregate_large(source(spark, SF), "credit_bureau_a_2", "sota_cat_661")
    keep = [c for c in whole.columns if c.rsplit("__", 1)[-1] in ("case_id", "max", "min", "nunique", "first", "last")]
    assert rows(split.select(keep)) == rows(whole.select(keep))


def test_many_cut_points_search_an_array(spark):
    points = tuple(float(i) for i in range(300))
    df = spark.createDataFrame([(-1.0,), (0.0,), (12.5,), (299.0,), (1e6,)], "x double")
    cuts = ordering.Cuts(points)
    assert [r[0] for r in df.select(cuts.bucket(F.col("x"))).collect()] == [0, 1, 13, 300, 300]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from evenkeel.sources.files import scan_projected, scan_week_range, write_feature_table

    path = f"{tmp_path}/wide"
    write_feature_table(frame(spark, SF, "base"), path, "WEEK_NUM", files=2)
    plan = scan_week_range(spark, path, "WEEK_NUM", 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(WEEK_NUM,3)" in plan and "LessThanOrEqual(WEEK_NUM,9)" in plan
    plan = scan_projected(spark, path, ["WEEK_NUM"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<WEEK_NUM:int>" in plan


def test_pruned_build_reads_only_what_outputs_need(spark):
    wide = build_features(source(spark, SF), "a2lite", "none", ["applprev_1__annuity_853A__mean"])
    assert wide.columns == ["case_id", "target", "applprev_1__annuity_853A__mean"]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    # The orders as base and one scan of the lines; the other groups are not even joined.
    assert plan.count("FileScan parquet") == 2 and "stddev" not in plan and "max(" not in plan
    counts = build_features(source(spark, SF), "baseline", "counts", ["person_1__row_count__log1p"])
    assert counts.columns == ["case_id", "target", "person_1__row_count__log1p"]


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 0), (2, 1.0, 1), (3, 3.0, 0), (4, nan, 1)], "id long, x double, target int")
    assert ordering.exact_medians(df, {"x": F.col("x")}) == {"x": 2.0}
    assert metrics.auc(df, "x").first()["n"] == 2
    got = aggregate_by_key(df.withColumn("k", F.lit(1)), "k", [Measure("m", "max", "x"), Measure("a", "mean", "x")]).first()
    assert (got["m"], got["a"]) == (3.0, 2.0)


def test_limits_never_change_results(spark):
    from evenkeel.operators.encode import category_codes
    from evenkeel.operators.joins import semi_filter as keep

    rng = random.Random(4)
    keys = [None, *[rng.choice((1, 1, 1, 2, 3, 4)) for _ in range(400)]]
    rows_ = [(k, rng.choice((None, "a", "b", "c")), rng.random()) for k in keys]
    df = spark.createDataFrame(rows_, "k long, s string, v double")
    right = spark.createDataFrame([(1, 10.0), (2, 20.0), (9, 90.0)], "k long, w double")
    for limit, hot in ((1000, 10**6), (1, 10**6), (1, 5), (1, 1)):
        got = lookup_join(df, right, "k", max_rows=limit, hot_rows=hot)
        assert sorted(map(str, got.collect())) == sorted(map(str, lookup_join(df, right, "k").collect()))
        assert sorted(map(str, keep(df, right.select("k"), "k", limit).collect())) == sorted(str(r) for r in df.where("k in (1, 2)").collect())
        codes = category_codes(df, "s", "c", max_rows=limit).select("s", "c").distinct().collect()
        assert {tuple(r) for r in codes} == {(None, -1), ("a", 0), ("b", 1), ("c", 2)}


def test_a_null_key_keeps_its_values(spark):
    data = [(None, i, float(i), "xyz"[i % 3]) for i in range(9)] + [(1, i, float(i), "q") for i in range(4)]
    df = spark.createDataFrame(data, "case_id long, num_group1 long, x_1A double, s_2M string")
    ms = [Measure(op, op, "x_1A") for op in ("mean", "median", "count")] + [Measure("d", "nunique", "s_2M", "raw"), Measure("t", "max", "s_2M", "raw")]
    for hot in (10**6, 2):
        got = {r["case_id"]: tuple(r)[1:] for r in aggregate_by_key(df, "case_id", ms, ("num_group1",), hot_rows=hot).collect()}
        assert got == {None: (4.0, 4.0, 9, 3, "z"), 1: (1.5, 1.5, 4, 1, "q")}


def test_two_sources_never_share_a_cached_table(spark, tmp_path):
    from evenkeel.sources.files import FeatureCache

    cache, seen = FeatureCache(str(tmp_path / "cache")), []
    for value in (1.0, 2.0):
        frames = {}
        for name, cols in (("base", "1L case_id, date'2020-01-01' date_decision, 202001 MONTH, 1 WEEK_NUM, 0 target"), ("static_0", f"1L case_id, {value}D v_1A"), ("static_cb_0", "1L case_id, 0D c_1A")):
            path = str(tmp_path / f"{name}{value}")
            spark.sql(f"SELECT {cols}").write.parquet(path)
            frames[name] = spark.read.parquet(path)
        seen.append(build_features(FrameSource(frames), "static", cache=cache).first()["v_1A"])
    assert seen == [1.0, 2.0]
    with pytest.raises(ValueError):
        FrameSource({"base": spark.range(1)}).fingerprint()


def test_only_grouped_tables_are_numbered_by_the_suffix_build(spark):
    from evenkeel.operators.joins import wide_left_join

    base = spark.createDataFrame([(1,)], "k long")
    parts = [spark.createDataFrame([(1, i)], "k long, v long") for i in range(4)]
    assert wide_left_join(base, parts[:2], "k", 2).columns == ["k", "v", "v_right"]
    assert wide_left_join(base, [parts[0], None, parts[2], parts[3]], "k", 2).columns == ["k", "v", "v_2", "v_3"]
    assert wide_left_join(base, parts[:2], "k", 0).columns == ["k", "v", "v_1"]


def test_constant_features_have_no_bins(spark):
    df = spark.createDataFrame([(i, i % 5, int(i > 30 or i % 7 == 0), 7.0, float(i)) for i in range(60)], "id long, WEEK_NUM int, target int, flat double, x double")
    report = {r["feature"]: r for r in lab.feature_report(df, ["flat", "x"], "id").collect()}
    assert (report["flat"]["iv"], report["flat"]["bin_target_rates"], report["flat"]["bin_monotonic_score"]) == (0.0, "[]", 0.0)
    assert report["x"]["iv"] > 0 and report["x"]["bin_target_rates"] != "[]"
    assert {r["feature"]: r["iv"] for r in lab.information_value(df, ["flat"], "id").collect()} == {"flat": 0.0}


def test_random_sample_is_exact_and_repeatable(spark):
    from evenkeel.operators.columns import sample_random

    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r[0] for r in sample_random(df, 137, "k").collect()}
    assert len(one) == 137 and one == {r[0] for r in sample_random(df.repartition(3), 137, "k").collect()}
    assert sample_random(df, 5000, "k").count() == 1000


def test_weight_grid_counts_in_whole_steps():
    grid = blend.weight_grid()
    assert len(grid) == 126 and all(abs(sum(t) - 1) < 1e-12 and t[2] <= 0.3 for t in grid) and grid == sorted(grid)


def test_folds_share_preprocessing_and_can_stop_early(spark):
    from evenkeel.operators.models import fit_gbt, fit_logistic
    from evenkeel.plans.validate import expanding_window_cv, oof_predictions
    from evenkeel.session import materialise

    rng = random.Random(9)
    data = [(i, i % 12, int(rng.random() < 0.3 + 0.4 * (i % 5 > 2)), float(i % 5), rng.random()) for i in range(600)]
    df = materialise(spark.createDataFrame(data, "case_id long, WEEK_NUM int, target int, a double, b double"))
    stop = lambda rows, features, flag: fit_gbt(rows, features, max_iter=8, max_depth=2, validation=flag)
    plain = lambda rows, features: fit_logistic(rows, features, max_iter=5)
    cv = {r["fold"]: r for r in expanding_window_cv(df, stop, valid_weeks=3, folds=2).collect()}
    assert sorted(cv) == [1, 2] and all(1 <= r["best_iteration"] <= 8 for r in cv.values())
    oof = oof_predictions(df, {"tree": stop, "line": plain}, valid_weeks=3, folds=2)
    assert oof.columns == ["fold", "case_id", "WEEK_NUM", "target", "tree_pred", "line_pred"] and oof.count() == 300
    from evenkeel.operators.metrics import auc as area

    got = {r["fold"]: r["auc"] for r in area(oof, "tree_pred", group=["fold"]).collect()}
    assert all(got[f] == pytest.approx(cv[f]["auc"], abs=1e-9) for f in cv)
