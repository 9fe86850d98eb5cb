"""Exact order statistics without ever sorting a whole group in one task.

Values are cut into buckets at approximate quantiles. The cut points are read once and put
into the plan as literals, so a bucket is a pure function of the value: retried tasks agree,
and the result never depends on how good the cut points are. Bucket totals (at most
``buckets`` per group) give each bucket's offset; inside a bucket an ordinary window runs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenkeel.functions.scalar import nan_to_null
from evenkeel.operators.skew import BROADCAST_ROWS, unpivot

MAX_BUCKETS = 1024
FEATURE_BLOCK = 50


def default_buckets(spark: SparkSession) -> int:
    """Enough buckets to keep every shuffle partition busy."""
    return max(32, min(MAX_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


@dataclass(frozen=True)
class Cuts:
    """Sorted distinct cut points; ``heavy`` ones were hit by several quantiles."""

    points: tuple[float, ...] = ()
    heavy: tuple[float, ...] = field(default=())

    def _literal(self, values: Sequence[float]) -> Column:
        # One text literal that folds to an array: a thousand points stay one plan node.
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")

    def count_le(self, x: Column) -> Column:
        """How many cut points are <= x, by binary search over an array literal. A tree of
        comparisons was measured slower: it outgrows what the JIT compiles."""
        if not self.points:
            return F.lit(0)
        steps, s = [], 1 << (len(self.points).bit_length() - 1)
        while s:
            steps.append(s)
            s >>= 1
        cuts = self._literal(self.points)
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda pos, step: F.when(F.get(cuts, pos + step - 1) <= x, pos + step).otherwise(pos),
        )

    def bucket(self, x: Column) -> Column:
        return self.count_le(x).cast("long")

    def bucket_with_ties(self, x: Column, tie: Column, tie_cuts: "Cuts") -> Column:
        """Monotone in (x, tie): a value that fills whole buckets is split further by ``tie``."""
        if not self.heavy:
            return self.bucket(x)
        width = len(tie_cuts.points) + 1
        idx = self.count_le(x)
        heavy = F.array_contains(self._literal(self.heavy), x)
        # Even positions hold the values between two cuts, odd ones a heavy value alone.
        lane = (idx * 2 - F.when(heavy, 1).otherwise(0)) * width
        inner = F.when(heavy, tie_cuts.count_le(tie)).otherwise(0)
        return (lane + inner).cast("long")


    def most_buckets(self, tie_cuts: "Cuts | None" = None) -> int:
        """Upper bound on the number of different buckets."""
        plain = len(self.points) + 1
        return plain + len(self.heavy) * (len(tie_cuts.points) + 1 if tie_cuts else 0)


def find_cuts(df: DataFrame, columns: Mapping[str, Column], buckets: int | None = None) -> dict[str, Cuts]:
    """Approximate quantiles of every column in one pass; one small row reaches the driver."""
    if not columns:
        return {}
    n = buckets or default_buckets(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    accuracy = max(1000, 4 * n)
    row = df.agg(
        *[
            F.percentile_approx(c.cast("double"), F.expr("array(" + ",".join(map(repr, probs)) + ")"), accuracy).alias(name)
            for name, c in columns.items()
        ]
    ).first()
    out = {}
    for name in columns:
        values = [v for v in row[name] or [] if v == v]
        seen = Counter(values)
        out[name] = Cuts(tuple(sorted(seen)), tuple(v for v in sorted(seen) if seen[v] > 1))
    return out


def _prefix(totals: DataFrame, group: Sequence[str], bucket: str, names: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *group, bucket, *[F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0)).alias(f"__o_{n}") for n in names]
    )


def known_number(c: Column) -> Column:
    """Double with NaN read as missing."""
    return nan_to_null(c.cast("double"))


def running_before(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    measures: Sequence[str],
    most_offsets: int | None = None,
) -> DataFrame:
    """Adds ``<m>_before``: the sum of m over the group's rows that sort earlier.

    ``order`` must be unique inside a group, and ``bucket`` monotone in it. ``most_offsets``
    is an upper bound on groups x buckets where the caller can prove one; a small bound lets
    the offsets be broadcast.
    """
    group = list(group)
    totals = df.groupBy(*group, bucket).agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    offsets = _prefix(totals, group, bucket, measures)
    if most_offsets is not None and most_offsets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    w = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = df.select(*df.columns, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"__b_{m}") for m in measures])
    return inside.join(offsets, [*group, bucket]).select(
        *df.columns, *[(F.col(f"__o_{m}") + F.col(f"__b_{m}")).alias(f"{m}_before") for m in measures]
    )


def rank_first(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    keep: Sequence[str] = (),
    buckets: int | None = None,
    cuts: Mapping[str, Cuts] | None = None,
) -> DataFrame:
    """Position of every non-null value inside its feature, ties in ``row_id`` order.

    Long result: row_id, keep, feature, x, r (from 1).
    """
    columns = {f: known_number(F.col(f)) for f in features}
    cuts = cuts or find_cuts(df, {**columns, "__row": F.col(row_id).cast("double")}, buckets)
    tie_cuts = cuts["__row"]
    tie = F.col(row_id).cast("double")
    long = unpivot(
        df,
        [row_id, *keep],
        [(f, {"x": c, "bucket": cuts[f].bucket_with_ties(c, tie, tie_cuts)}) for f, c in columns.items()],
    ).where(F.col("x").isNotNull())
    most = sum(cuts[f].most_buckets(tie_cuts) for f in features)
    ranked = running_before(long.withColumn("one", F.lit(1)), ["feature"], "bucket", ["x", row_id], ["one"], most)
    return ranked.select(row_id, *keep, "feature", "x", (F.col("one_before") + 1).alias("r"))


def value_counts(
    df: DataFrame,
    features: Mapping[str, Column],
    measures: Mapping[str, Column | Callable[[str], Column]] | None = None,
    group: Sequence[str] = (),
    buckets: int | None = None,
    cuts: Mapping[str, Cuts] | None = None,
) -> DataFrame:
    """Collapse each feature to its distinct values: group, feature, x, bucket, n and summed measures.

    A measure is a column, or a function of the feature name that gives one.
    """
    measures = measures or {}
    columns = {f: known_number(c) for f, c in features.items()}
    cuts = cuts or find_cuts(df, columns, buckets)

    def fields(name: str, c: Column) -> dict[str, Column]:
        extra = {m: spec(name) if callable(spec) else spec for m, spec in measures.items()}
        return {"x": c, "bucket": cuts[name].bucket(c), **extra}

    long = unpivot(df, list(group), [(f, fields(f, c)) for f, c in columns.items()]).where(F.col("x").isNotNull())
    return long.groupBy(*group, "feature", "x", "bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]
    )


def quantiles_of_counts(
    counts: DataFrame, probs: Sequence[float], group: Sequence[str] = (), most_rows: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles of (group, feature, x, bucket, n) rows: group, feature, i, q.

    Bucket totals, combined before the shuffle, tell which buckets hold the wanted positions;
    only rows of those are collapsed and sorted. ``most_rows`` is a proven bound on the number
    of such buckets, if there is one.
    """
    keys = [*group, "feature"]
    by_bucket = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("__t_n"))
    run = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = by_bucket.select(
        *keys,
        "bucket",
        F.coalesce(F.sum("__t_n").over(run), F.lit(0)).alias("offset"),
        F.col("__t_n").alias("held"),
        F.sum("__t_n").over(W.partitionBy(*keys)).alias("total"),
    )
    pos = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.floor(p).alias("lo"), F.ceil(p).alias("hi"), (p - F.floor(p)).alias("frac"))
            for i, p in enumerate(pos)
        ]
    )

    def covers(first: Column, last: Column):
        return lambda s: s["lo"].between(first, last) | s["hi"].between(first, last)

    here = F.filter(wanted, covers(F.col("offset"), F.col("offset") + F.col("held") - 1))
    needed = placed.select(*keys, "bucket", "offset", here.alias("here")).where(F.size("here") > 0)
    if most_rows is not None and most_rows <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    inside = W.partitionBy(*keys, "bucket").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    few = counts.join(needed, [*keys, "bucket"]).groupBy(*keys, "bucket", "x").agg(
        F.sum("n").alias("n"), F.first("offset").alias("offset"), F.first("here").alias("here")
    )
    ranked = few.withColumn("a", first)
    hit = F.filter("here", covers(F.col("a"), F.col("a") + F.col("n") - 1))
    cells = ranked.select(*keys, "x", "a", (F.col("a") + F.col("n") - 1).alias("b"), F.explode(hit).alias("s")).select(
        *keys, "x", "a", "b", "s.*"
    )
    ends = cells.groupBy(*keys, "i").agg(
        F.max(F.when(F.col("lo").between(F.col("a"), F.col("b")), F.col("x"))).alias("x_lo"),
        F.max(F.when(F.col("hi").between(F.col("a"), F.col("b")), F.col("x"))).alias("x_hi"),
        F.max("frac").alias("frac"),
    )
    return ends.select(*keys, "i", (F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * F.col("frac")).alias("q"))


def exact_quantiles(
    df: DataFrame,
    features: Mapping[str, Column],
    probs: Sequence[float],
    group: Sequence[str] = (),
    buckets: int | None = None,
    groups: int | None = 1,
) -> DataFrame:
    """Quantiles per feature, or per group and feature; ``groups`` is their number if known."""
    columns = {f: known_number(c) for f, c in features.items()}
    cuts = find_cuts(df, columns, buckets)
    entries = [(f, {"x": c, "bucket": cuts[f].bucket(c), "n": F.lit(1)}) for f, c in columns.items()]
    rows = unpivot(df, list(group), entries).where(F.col("x").isNotNull())
    most = None if groups is None else 2 * groups * len(columns) * len(probs)
    return quantiles_of_counts(rows, probs, group, most)


def blocks(names: Sequence[str], size: int = FEATURE_BLOCK) -> list[list[str]]:
    """Runs of names that share one job, so that no plan grows with the number of features."""
    return [list(names[i : i + size]) for i in range(0, len(names), size)]


def exact_medians(df: DataFrame, features: Mapping[str, Column], buckets: int | None = None) -> dict[str, float | None]:
    """Whole-table medians; one row per feature reaches the driver."""
    found: dict[str, float | None] = {}
    for block in blocks(list(features)):
        rows = exact_quantiles(df, {f: features[f] for f in block}, [0.5], buckets=buckets).collect()
        found |= {r["feature"]: r["q"] for r in rows}
    return {name: found.get(name) for name in features}
