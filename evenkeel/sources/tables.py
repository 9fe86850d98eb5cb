"""Scans: table groups spread over files, schema reconciliation, typed reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.naming import DEFAULT, Naming
from evenkeel.functions.scalar import normalize_dates
from evenkeel.operators.joins import keep_last, semi_filter
from evenkeel.sources.footers import same_schema

FILE_ORDER = ("__file", "__row")


def glob_files(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified) of every match, sorted, on whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path) or []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)


def resolve_group_files(spark: SparkSession, data_dir: str, split: str, group: str) -> list[str]:
    """Sorted files of a table group; having none is an error."""
    pattern = f"{str(data_dir).rstrip('/')}/parquet_files/{split}/{split}_{group}*.parquet"
    paths = [p for p, _, _ in glob_files(spark, pattern)]
    if not paths:
        raise FileNotFoundError(f"group {group!r} of split {split!r} has no files")
    return paths


def reconcile_schemas(schemas: Sequence[T.StructType], naming: Naming = DEFAULT) -> dict[str, T.DataType]:
    """First non-null type per column in file order; keys are long, all-null columns text."""
    target: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            if isinstance(target.get(f.name, T.NullType()), T.NullType):
                target[f.name] = f.dataType
    for name, dtype in target.items():
        if name in (naming.key, *naming.ordinals):
            target[name] = T.LongType()
        elif isinstance(dtype, T.NullType):
            target[name] = T.StringType()
    return target


def conform(df: DataFrame, target: Mapping[str, T.DataType], extra: Sequence[str] = ()) -> DataFrame:
    """Lenient cast to the target types; missing columns become null."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str, dtype: T.DataType) -> Column:
        if name not in have or isinstance(have[name], T.NullType):
            return F.lit(None).cast(dtype).alias(name)
        c = F.col(f"`{name}`")
        return c if have[name] == dtype else c.try_cast(dtype).alias(name)

    return df.select(*[cell(n, t) for n, t in target.items()], *extra)


def read_reconciled(
    spark: SparkSession, paths: Sequence[str], naming: Naming = DEFAULT, position: bool = False
) -> DataFrame:
    """Files of possibly different schemas as one frame.

    Files that share a schema are read together, so the plan has one scan, and the driver asks for one schema,
    per distinct schema and not per file; which files share one is found by a job over the footers.
    ``position`` adds the file and the row inside it.
    """
    groups = [(spark.read.parquet(members[0]).schema, members) for members in same_schema(spark, paths)]
    target = reconcile_schemas([schema for schema, _ in groups], naming)
    extra = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    frames = [
        conform(spark.read.schema(schema).parquet(*members), target, extra if position else ())
        for schema, members in groups
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


class TableSource(Protocol):
    """Where a build finds its table groups."""

    naming: Naming

    def table(self, group: str) -> DataFrame: ...

    def ordered(self, group: str) -> tuple[DataFrame, tuple[str, ...]]: ...

    def fingerprint(self) -> str: ...


@dataclass(frozen=True)
class ParquetLayout:
    """Table groups as ``parquet_files/<split>/<split>_<group>*.parquet``."""

    spark: SparkSession
    data_dir: str
    split: str
    naming: Naming = DEFAULT

    def paths(self, group: str) -> list[str]:
        return resolve_group_files(self.spark, self.data_dir, self.split, group)

    def table(self, group: str) -> DataFrame:
        return read_reconciled(self.spark, self.paths(group), self.naming)

    def ordered(self, group: str) -> tuple[DataFrame, tuple[str, ...]]:
        return read_reconciled(self.spark, self.paths(group), self.naming, position=True), FILE_ORDER

    def fingerprint(self) -> str:
        files = glob_files(self.spark, f"{self.data_dir.rstrip('/')}/parquet_files/{self.split}/*.parquet")
        return repr(files)


@dataclass(frozen=True)
class FrameSource:
    """Table groups given as DataFrames; ``orders`` says which row of a key comes last."""

    frames: Mapping[str, DataFrame]
    orders: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    naming: Naming = DEFAULT

    def table(self, group: str) -> DataFrame:
        if group not in self.frames:
            raise FileNotFoundError(f"the source has no table {group!r}")
        return self.frames[group]

    def ordered(self, group: str) -> tuple[DataFrame, tuple[str, ...]]:
        df = self.table(group)
        order = self.orders.get(group) or tuple(c for c in df.columns if c != self.naming.key)
        if self.naming.key not in df.columns:
            raise ValueError(f"{group} has no {self.naming.key}")
        marks = tuple(f"__order{i}" for i in range(len(order)))
        return df.withColumns({m: F.col(c) for m, c in zip(marks, order)}), marks

    def fingerprint(self) -> str:
        """What the frames read (files with length and time) and how (the analysed plans). Frames that read no files can't be told apart later."""
        parts = []
        for group in sorted(self.frames):
            df = self.frames[group]
            files = sorted(df.inputFiles())
            if not files:
                raise ValueError(f"{group} reads no files, so what it holds can't be recognised; don't cache this source")
            spark = df.sparkSession
            parts.append((group, df.semanticHash(), [glob_files(spark, f)[:1] for f in files], self.orders.get(group)))
        return repr(parts)


def scan_group(source: TableSource, group: str) -> DataFrame:
    return source.table(group)


def load_base(source: TableSource) -> DataFrame:
    return normalize_dates(source.table("base"), source.naming)


def load_depth0(source: TableSource, group: str, ids: DataFrame | None = None) -> DataFrame:
    """At most one row per case: the last one in file order."""
    df, order = source.ordered(group)
    df = normalize_dates(df, source.naming)
    if ids is not None:
        df = semi_filter(df, ids, source.naming.key)
    return keep_last(df, source.naming.key, order, drop_order=True)


def set_table_dtypes(df: DataFrame, naming: Naming = DEFAULT, integer: str = "bigint") -> DataFrame:
    """Types by name: long keys, double for P and A, text for M, dates for D."""
    whole = {naming.key, naming.week, *naming.ordinals}
    by_suffix = {"P": "double", "A": "double", "M": "string", naming.date_suffix: "date"}
    out = {}
    for name in df.columns:
        dtype = integer if name in whole else "date" if name == naming.decision else by_suffix.get(name[-1:])
        if dtype:
            out[name] = F.col(name).try_cast(dtype)
    return df.withColumns(out) if out else df


def read_typed(
    spark: SparkSession,
    pattern: str,
    aggregate=None,
    naming: Naming = DEFAULT,
) -> DataFrame:
    """All matching files, typed by name, with an optional DataFrame -> DataFrame aggregation.

    The aggregation sees all files at once, so a case spread over files keeps all its rows;
    without one the last row per case in file order is kept.
    """
    paths = [p for p, _, _ in glob_files(spark, pattern)]
    if not paths:
        raise FileNotFoundError(f"{pattern!r} names no file")
    df = read_reconciled(spark, paths, naming, position=aggregate is None)
    if aggregate is not None:
        return aggregate(set_table_dtypes(df, naming))
    return keep_last(set_table_dtypes(df, naming), naming.key, FILE_ORDER, drop_order=True)
