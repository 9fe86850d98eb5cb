"""Connected components of a graph given by its links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node that can be reached.

    Two alternating steps on the whole set of links: each node's larger neighbours are tied to its least
    neighbour, then its smaller neighbours and itself are. Groups become stars in a logarithmic number of rounds.
    Partial minima are taken before every shuffle, and each round is written to the shared folder.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        wide = wide.where("a <> b").distinct()
        down = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        pairs = materialise(near.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "links")
        # The same number of links and the same sum of hashes: nothing moved.
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
