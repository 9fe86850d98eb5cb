"""Footers read by a job, summaries of frequent keys, and the weight grid evaluated by ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import blend as B
from evenkeel.operators import skew
from evenkeel.sources.footers import same_schema, schema_key
from evenkeel.sources.tables import read_reconciled


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    df = spark.range(40).selectExpr("id as case_id", "cast(id as int) as v", "cast(id as string) as s")
    kinds = [df, df.withColumn("v", F.col("v").cast("string")), df.drop("s"), df, df.withColumn("v", F.lit(None).cast("int")), df.drop("s")]
    paths = [f"{folder}/f{i}.parquet" for i in range(len(kinds))]
    for i, (path, kind) in enumerate(zip(paths, kinds)):
        kind.where(F.col("case_id") % 6 == i).coalesce(1).write.parquet(path)
    df.write.partitionBy("v").parquet(f"{folder}/parted.parquet")
    return paths, f"{folder}/parted.parquet"


def test_files_meet_by_their_stored_schema(spark, files):
    paths, parted = files
    for per_task in (1, 4, 64):
        found = same_schema(spark, [*paths, parted], per_task)
        # The fifth file may hold nulls where the first may not.
        assert [[[*paths, parted].index(p) for p in g] for g in found] == [[0, 3], [1], [2, 5], [4], [6]]
    assert schema_key(parted) is None
    assert schema_key("nosuch://host/a.parquet") is None
    assert schema_key(f"file:{paths[0]}") == schema_key(paths[0])


def test_files_of_drifting_schemas_read_as_one(spark, files):
    paths, _ = files
    df = read_reconciled(spark, paths, position=True)
    rows = {r["case_id"]: r for r in df.collect()}
    assert sorted(rows) == list(range(40)) and dict(df.dtypes)["v"] == "int"
    assert rows[7]["v"] == 7 and rows[4]["v"] is None and rows[8]["s"] is None and rows[3]["s"] == "3"
    # One scan for each distinct schema, not for each file.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 4


def test_frequent_keys_are_found_without_counting_all(spark, monkeypatch):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"))
    cell = df.where("k = 5").select(skew.hot_cell("k")).first()[0]
    blank = df.where("k is null").select(skew.hot_cell("k")).first()[0]
    assert skew.hot_cells(df, "k", 5_000) == [cell]
    assert skew.hot_cells(df, "k", 1_500) == sorted({cell, blank})
    assert skew.hot_cells(df.limit(0), "k", 10) == []
    monkeypatch.setattr(skew, "HOT_CELLS", 1)
    assert skew.hot_cells(df, "k", 5_000) == [0]


def _brute(rows, weights):
    def auc(scored):
        pos = [s for s, t in scored if t]
        neg = [s for s, t in scored if not t]
        won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        return won / (len(pos) * len(neg)) if pos and neg else None

    scored = []
    for t, w, *p in rows:
        if t is not None and all(x is not None and not math.isnan(x) for x in p):
            scored.append((weights[0] * p[0] + weights[1] * p[1] + weights[2] * p[2], t, w))
    weeks = [2 * a - 1 for k in {w for *_, w in scored if w is not None} if (a := auc([(s, t) for s, t, w in scored if w == k])) is not None]
    return auc([(s, t) for s, t, _ in scored]), sum(weeks) / len(weeks), len(weeks)


@pytest.mark.parametrize("ranges", [7, 10_000])
def test_weight_grid_by_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(B, "RANGE_ROWS", ranges)
    monkeypatch.setattr(B, "GRID_BLOCK", 2)
    r = random.Random(3)
    cell = lambda: r.choice([0.0, 0.25, 0.5, 1.0, round(r.random(), 2)])
    rows = [(r.randint(0, 1), r.choice([1, 2, 3, None]), cell(), cell(), cell()) for _ in range(150)]
    rows += [(None, 1, 0.5, 0.5, 0.5), (1, 2, None, 0.5, 0.5), (1, 2, float("nan"), 0.5, 0.5), (1, 9, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "target int, WEEK_NUM int, a double, b double, c double")
    got = B.blend_weight_search(df, {"a": "a", "b": "b", "c": "c"}, step=0.5, max_third=0.5).collect()
    assert len(got) == len(B.weight_grid(0.5, 0.5))
    for g in got:
        auc, mean, weeks = _brute(rows, (g["a_weight"], g["b_weight"], g["c_weight"]))
        assert g["auc"] == pytest.approx(auc, abs=1e-12) and g["mean_gini"] == pytest.approx(mean, abs=1e-12) and g["n_weeks"] == weeks


def test_weight_grid_of_an_empty_table(spark):
    df = spark.createDataFrame([], "target int, WEEK_NUM int, a double, b double, c double")
    assert B.blend_weight_search(df, {"a": "a", "b": "b", "c": "c"}, step=0.5).collect() == []


def test_written_tables_are_removed_on_release(spark):
    from evenkeel import session

    session.release(spark)
    df = session.materialise(spark.range(5), "mine")
    assert df.count() == 5 and len(df.inputFiles()) > 0
    with pytest.raises(ValueError):
        session.remove(spark, "/somewhere/else")
    assert session.release(spark) == 1 and session.release(spark) == 0
    with pytest.raises(Exception, match="FileNotFound|does not exist|PATH_NOT_FOUND|FAILED_READ_FILE"):
        df.count()
