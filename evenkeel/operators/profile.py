"""Column profiles: one wide pass for cheap statistics, one narrow pass for distinct counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.naming import split_feature_name
from evenkeel.operators.skew import unpivot

BLOCK = 100


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: T.DataType
    rows: int
    nulls: int
    distinct: int  # nulls not counted

    @property
    def missing_rate(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    @property
    def distinct_with_null(self) -> int:
        return self.distinct + (1 if self.nulls else 0)

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, rows, nulls, nunique for every column.

    Distinct values are counted in (feature, value) rows, so that one frequent value or one
    wide column cannot fill a task; nulls and rows come from the same counts.
    """
    parts = []
    for start in range(0, len(columns), BLOCK):
        block = columns[start : start + BLOCK]
        values = unpivot(df, [], [(c, {"v": F.col(f"`{c}`").cast("string")}) for c in block])
        counts = values.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            counts.groupBy("feature").agg(
                F.sum("n").alias("rows"),
                F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                F.count("v").alias("nunique"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, enough: int | None = None
) -> dict[str, ColumnProfile]:
    """Profiles for plan-time decisions; one small row per column reaches the driver.

    With ``enough`` of 2 or less the caller only asks whether a non-text column varies: its
    smallest and largest value tell that in one pass without a shuffle, and ``distinct`` stops
    at 2. Text is always counted exactly.
    """
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return {}
    brief = [c for c in columns if enough is not None and enough <= 2 and not isinstance(df.schema[c].dataType, T.StringType)]
    exact = [c for c in columns if c not in set(brief)]
    found: dict[str, tuple[int, int, int]] = {}
    for start in range(0, len(brief), BLOCK):
        block = brief[start : start + BLOCK]
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[
                e
                for i, c in enumerate(block)
                for e in (
                    F.count(f"`{c}`").alias(f"n{i}"),
                    (F.min(f"`{c}`") < F.max(f"`{c}`")).alias(f"v{i}"),
                )
            ],
        ).first()
        for i, c in enumerate(block):
            known = row[f"n{i}"]
            found[c] = (row["rows"], row["rows"] - known, 0 if not known else 2 if row[f"v{i}"] else 1)
    if exact:
        for r in column_counts(df, exact).collect():
            found[r["feature"]] = (r["rows"], r["nulls"], r["nunique"])
    return {c: ColumnProfile(c, df.schema[c].dataType, *found.get(c, (0, 0, 0))) for c in columns}


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature: dtype, name parts, missing rate, distinct count, constant flag."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [(c, types[c], *split_feature_name(c)) for c in columns]
    labels = df.sparkSession.createDataFrame(
        names, "feature string, dtype string, table_prefix string, agg_suffix string"
    )
    counts = column_counts(df, columns)
    return counts.join(F.broadcast(labels), "feature").select(
        "feature",
        "dtype",
        "table_prefix",
        "agg_suffix",
        (F.col("nulls") / F.col("rows")).alias("missing_rate"),
        "nunique",
        (F.col("nunique") <= 1).alias("is_constant"),
    )


def column_fingerprints(df: DataFrame, columns: Sequence[str], row_key: str) -> dict[str, str]:
    """Order-free sum of row hashes. The key is hashed along, so a permuted column differs."""
    cells = [
        F.sum(F.xxhash64(F.col(row_key), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))).cast("decimal(38,0)"))
        .alias(f"f{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(*cells).first()
    return {c: str(row[f"f{i}"]) for i, c in enumerate(columns)}


def duplicate_columns(df: DataFrame, columns: Sequence[str], row_key: str) -> list[tuple[str, str]]:
    """(feature, first column with the same content)."""
    seen: dict[str, str] = {}
    out = []
    for c, mark in column_fingerprints(df, columns, row_key).items():
        if mark in seen:
            out.append((c, seen[mark]))
        else:
            seen[mark] = c
    return out


def duplicate_report(df: DataFrame, columns: Sequence[str], row_key: str) -> DataFrame:
    found = duplicate_columns(df, columns, row_key)
    return df.sparkSession.createDataFrame(found, "feature string, duplicate_of string")


def roll_up(profile: DataFrame, by: str) -> DataFrame:
    """Feature counts and missing rates per table prefix or aggregate suffix."""
    return (
        profile.groupBy(by)
        .agg(
            F.count("feature").alias("features"),
            F.avg("missing_rate").alias("mean_missing"),
            F.max("missing_rate").alias("max_missing"),
            F.sum(F.col("is_constant").cast("int")).alias("constant_features"),
            F.count("duplicate_of").alias("duplicate_features"),
        )
        .orderBy(F.desc("features"), F.desc("mean_missing"))
    )


def null_profile_by_file(df: DataFrame, columns: Sequence[str], file: str = "file") -> DataFrame:
    """Per file and column: rows, missing rate, min, max, mean of the lenient double."""
    long = unpivot(df, [file], [(c, {"x": F.col(c).try_cast("double")}) for c in columns])
    return long.groupBy(file, "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("x").isNull().cast("int")).alias("missing_rate"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("mean"),
    )
