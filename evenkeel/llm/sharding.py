"""Shards of nearly equal bytes by a minimax contiguous partition.

Documents of equal text are one atomic group. Groups stand in the order of their texts' digests, and the
smallest capacity is searched for which a greedy walk over the order needs no more than the given number of
shards. The walk's steps are look-ups in the running sums of the group sizes; many capacities are tried
in one pass, so a few short jobs settle the search. The cuts are digests: a row knows its shard
from its own digest, and no row is joined to anything. Everything is built from DataFrame functions.

Defined results: a null text counts as an empty one (0 bytes, crc32 0) but as a group of its own; rows without an
id come first in their group; repeated rows are members each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.frames import id_and_text
from evenkeel.session import materialise

SHARDS = 8
#: Capacities tried in one pass of the search.
TRIED = 64


def _running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums over the whole order: (name, column) pairs of sums.

    The order is cut into ranges; sums inside a range and the few totals of the ranges are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    # One row per range.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("__range", *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    out = out.join(F.broadcast(begins), "__range")
    return out.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).drop("__range", *[f"__{name}" for name in sums])


def _steps(sums: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity the running sums at which a greedy walk cuts, a list of at most so many."""
    at: list[list[int]] = [[0] for _ in capacities]
    for _ in range(shards):
        # Only the stretch of the order that some walk looks at is read.
        lo, hi = min(a[-1] for a in at), max(a[-1] + c for a, c in zip(at, capacities))
        near = sums.where((F.col("upto") > lo) & (F.col("upto") <= hi))
        found = near.agg(*[F.max(F.when(F.col("upto") <= a[-1] + c, F.col("upto"))) for a, c in zip(at, capacities)]).first()
        for a, x in zip(at, found):
            a.append(max(a[-1], x if x is not None else a[-1]))
    return [a[1:] for a in at]


def smallest_capacity(sums: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The minimax capacity over ordered groups (size, upto: running sum), and the running sums at its cuts."""
    total, most = sums.agg(F.max("upto"), F.max("size")).first()
    if total is None:
        return 0, [0] * shards
    # One group at least, an even share at least; an even share and one group more always suffice.
    low = max(most, -(-total // shards))
    high = max(low, -(-total // shards) + most)
    while low < high:
        tried = sorted({low + (high - low) * k // TRIED for k in range(TRIED)})
        ends = [s[-1] for s in _steps(sums, tried, shards)]
        fits = [c for c, end in zip(tried, ends) if end == total]
        fails = [c for c, end in zip(tried, ends) if end < total]
        high = min(fits, default=high)
        low = max([low, *(c + 1 for c in fails)])
    return low, _steps(sums, [low], shards)[0]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and capacity of every document."""
    text = F.coalesce("text", F.lit(""))
    group: Column = F.when(F.col("text").isNull(), F.lit("")).otherwise(F.sha2("text", 256))
    rows = id_and_text(docs).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), group.alias("group")
    )
    rows = materialise(rows, "rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    sums = materialise(_running(groups, ["group"], {"upto": "size"}), "sums")
    capacity, ends = smallest_capacity(sums, shards)
    cuts = {r["upto"]: r["group"] for r in sums.where(F.col("upto").isin(ends)).collect()}
    last = [cuts[e] for e in sorted(set(ends)) if e in cuts]
    number = F.lit(0)
    for digest in last[:-1]:
        number = number + F.when(F.col("group") > digest, 1).otherwise(0)
    # The id orders a group's members, so that a hot group is cut into ranges too; equal rows take any order once written.
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long"))
    placed = _running(rows, ["group", "doc_id", "row"], {"rank": "one"}).withColumn("shard", number.cast("int"))
    placed = materialise(placed, "ranks")
    begins = placed.groupBy("shard").agg(F.min("rank").alias("begin"))
    out = placed.join(F.broadcast(begins), "shard")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("begin")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
    )
