"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores of the local session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from evenkeel.queries import all_queries
from evenkeel.session import local_session

HEADLINE = (
    "build_features",
    "wide_left_join",
    "agg_policy_default",
    "agg_policy_ex2",
    "agg_policy_lgb644_large",
    "agg_large_lite",
    "agg_median",
    "case_final_merge",
    "load_depth0",
    "stability_metric",
    "single_model_scores",
    "blend_weight_search",
    "feature_profile",
    "feature_report",
    "quantile_bucket",
    "count_encode",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        # The noop sink computes every row and column without sending them to the driver.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
