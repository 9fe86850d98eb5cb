"""Helpers that keep one hot key, value or group from landing in a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A median buffer holds a key's distinct values of every column; this keeps it to megabytes.
HOT_ROWS = 100_000
# Hot keys are known by cells of their hash. So many numbers at most reach the driver, whatever the data.
HOT_CELLS = 4096
SLICES = 32
# Items of a summary of frequent keys.
TRACKED = 16384


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measured, not assumed: true when ``df`` has at most so many rows and bytes."""
    texts = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    held = [F.sum(F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))) for c in texts]
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)), *held).first()
    return row[0] <= max_rows and row[0] * 8 * len(df.columns) + sum(x or 0 for x in row[1:]) <= max_bytes


def hot_cell(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(HOT_CELLS)).cast("int")


def hot_cells(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[int]:
    """The cells that hold a key with more than ``hot_rows`` rows. Other keys may share a cell; that costs
    work and changes no result.

    Keys are counted by mergeable summaries of ``TRACKED`` frequent items, one a task, so nothing is shuffled by key and
    the pass reads the key column only. A key that they miss holds less than 2 / ``TRACKED`` of the rows.
    If more keys are hot than there are cells, all cells are.
    """
    hashed = df.select(F.xxhash64(F.col(key)).alias("__h"))
    top = hashed.agg(F.expr(f"approx_top_k(__h, {HOT_CELLS}, {TRACKED})").alias("t")).first()["t"] or []
    hot = [r["item"] for r in top if r["count"] > hot_rows]
    return list(range(HOT_CELLS)) if len(hot) == HOT_CELLS else sorted({h % HOT_CELLS for h in hot})


def skewed_join(
    df: DataFrame, right: DataFrame, key: str, how: str, max_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``left`` or ``left_semi`` join to a table with unique keys that survives hot keys on the left.

    A right side that is measured small is broadcast. Otherwise the rows of hot keys are dealt over slices by a hash of
    their other columns, and the right rows of these keys are repeated once per slice. Rows without a
    key need no match. A row's slice follows from its columns and its partition's number, which a repeated task keeps, so
    retries agree; the number parts rows that are equal in all columns.
    """
    if how not in ("left", "left_semi"):
        raise ValueError(f"how={how!r}")
    if fits_broadcast(right, max_rows):
        return df.join(F.broadcast(right), key, how)
    added = [c for c in right.columns if c != key] if how == "left" else []
    keyed = df.where(F.col(key).isNotNull())
    cells = hot_cells(keyed, key, hot_rows)
    if cells:
        hot = hot_cell(key).isin(cells)
        slice_of = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns]), F.lit(SLICES)).cast("int")
        keyed = keyed.withColumn("__slice", F.when(hot, slice_of).otherwise(0))
        every = F.when(hot, F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
        joined = keyed.join(right.withColumn("__slice", F.explode(every)), [key, "__slice"], how).drop("__slice")
    else:
        joined = keyed.join(right, key, how)
    out = joined.select(*df.columns, *added)
    if how == "left":
        blank = df.where(F.col(key).isNull())
        out = out.unionByName(blank.withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in added}))
    return out


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, **limits) -> DataFrame:
    """Columns of a table with unique keys, null where there is no match."""
    return skewed_join(df, lookup, key, "left", **limits)


def unpivot(
    df: DataFrame,
    keep: Sequence[str],
    entries: Sequence[tuple[str, dict[str, Column]]],
    name: str = "feature",
) -> DataFrame:
    """One row per (row, entry): ``keep`` columns, the entry's name and its fields."""
    packed = [F.struct(F.lit(label).alias(name), *(c.alias(n) for n, c in fields.items())) for label, fields in entries]
    long = df.select(*keep, F.explode(F.array(*packed)).alias("__cell"))
    return long.select(*keep, "__cell.*")
