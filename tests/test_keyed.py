"""Tables stored by case: the same rows as without, hot and null cases included, and no exchange by group."""

import datetime
import random

import pytest

from evenkeel.plans.wide import aggregate_group, build_features
from evenkeel.queries import bindings
from evenkeel.queries.bindings import by_case, source


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Own rows: case 1 is hot, some rows have no case, some cases have no order."""
    rng, out = random.Random(7), tmp_path_factory.mktemp("keyed")
    day = lambda: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rng.randrange(2000))
    keys = [1] * 40 + [None] * 12 + [rng.randrange(2, 60) for _ in range(300)]
    lines = [
        (k, rng.randrange(900), rng.randrange(90), i, float(rng.randrange(50)), rng.random() * 1000, rng.randrange(10) / 100, rng.randrange(9) / 100,
         rng.choice("ANR"), rng.choice("OF"), day())
        for i, k in enumerate(keys)
    ]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
        " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{out}/lineitem.parquet")
    orders = [(k, rng.randrange(9), rng.choice("OF"), rng.random() * 1000, day()) for k in (*range(1, 50), None, 70)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
    spark.createDataFrame(orders, schema).write.parquet(f"{out}/orders.parquet")
    customers = [(k, f"c{k}", k % 25, float(k), rng.choice(("AUTO", "FOOD"))) for k in range(8)]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(customers, schema).write.parquet(f"{out}/customer.parquet")
    return str(out)


def _rows(df):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())


def _groups(feature_set, groups):
    def run(src, hot_rows):
        out = None
        for g in groups:
            part = aggregate_group(src, g, feature_set, hot_rows=hot_rows)
            out = part if out is None else out.join(part, "case_id")
        return out

    return run


RUNS = {
    "letters": _groups("sota_cat_661", ("applprev_1", "person_2", "credit_bureau_b_1")),
    "a2core": lambda src, hot_rows: build_features(src, "a2core", hot_rows=hot_rows),
}


@pytest.mark.parametrize("name", RUNS)
def test_stored_by_case_gives_the_same_rows(spark, folder, name):
    assert _rows(by_case(spark, folder, RUNS[name], 20)) == _rows(RUNS[name](source(spark, folder), 100_000))


@pytest.mark.parametrize("name, most", [("letters", 0), ("a2core", 4)])
def test_groups_share_the_exchange_of_their_table(spark, folder, name, most, monkeypatch):
    """Every group was shuffled by case up to four times, and all that lay on disk at once. What is left is the look-up of customers."""
    real = bindings.split_by_key
    monkeypatch.setattr(bindings, "split_by_key", lambda *a: (real(*a)[0], None))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = by_case(spark, folder, RUNS[name])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= most
