"""Small helpers of the operators: columns to read, bounded counters, rows as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Arrays that one group adds up, and how often: enough for 64 ** 3 partitions, beyond which a few more arrays reach the driver.
ADDED, LEVELS = 64, 3


def id_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id as a long and the text; whatever other columns there are stay out of the way."""
    return df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias(text))


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """Columns (lists or arrays) as one Arrow batch of the schema."""
    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields
    )


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function that yields lists of columns."""
    kind = schema_of(schema) if isinstance(schema, str) else schema

    def run(batches):
        for columns in fn(batches):
            yield batch(kind, columns)

    return df.mapInArrow(run, kind)


def counted(df: DataFrame, cells: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int, pieces: int = 16) -> np.ndarray:
    """``counted_over`` with a function of one batch."""
    return counted_over(df, lambda batches: (c for b in batches for c in cells(b)), size, pieces)


def counted_over(df: DataFrame, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int, pieces: int = 16) -> np.ndarray:
    """How often each of ``size`` cells is named over all rows; ``cells`` is given a task's batches.

    Every task adds up one array of ``size`` counters, so what is shuffled, and the one array that
    reaches the driver, are bounded by that parameter and not by the data.
    """
    width = -(-size // pieces)

    def count(batches):
        total = np.zeros(width * pieces, np.int64)
        for c in cells(batches):
            total += np.bincount(c, minlength=width * pieces)
        if total.any():
            yield [list(range(pieces)), [total[i * width : (i + 1) * width].tobytes() for i in range(pieces)]]

    kind = schema_of("piece int, part int, cells binary")

    def add(key, table):
        total = np.zeros(width, np.int64)
        for x in table.column("cells").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.Table.from_batches([batch(kind, [[key[0].as_py()], [key[1].as_py()], [total.tobytes()]])])

    sums = map_batches(df, count, "piece int, cells binary").withColumn("part", F.spark_partition_id())
    for _ in range(LEVELS):
        # A group is never more than so many arrays, however many partitions there are.
        sums = sums.withColumn("part", F.expr(f"part div {ADDED}").cast("int")).groupBy("piece", "part").applyInArrow(add, kind)
    rows = sums.collect()
    out = np.zeros(width * pieces, np.int64)
    for r in rows:
        out[r["piece"] * width : (r["piece"] + 1) * width] += np.frombuffer(bytes(r["cells"]), np.int64)
    return out[:size]
