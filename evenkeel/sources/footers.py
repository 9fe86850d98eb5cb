"""Which files share a schema, found from their footers in one Spark job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Footers that one task reads.
FILES_PER_TASK = 64
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path; Hadoop writes local ones as ``file:/a``."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def schema_key(path: str) -> str | None:
    """A digest of a file's stored schema; of the first part file for a folder.

    None where only Spark can tell: a folder with partition columns or without part files, or a file system that
    isn't known here.
    """
    try:
        system, place = _open(path)
        if system.get_file_info(place).type == fs.FileType.Directory:
            inside = [i for i in system.get_file_info(fs.FileSelector(place)) if not i.base_name.startswith(("_", "."))]
            if not inside or any(i.type == fs.FileType.Directory for i in inside):
                return None
            place = min(i.path for i in inside)
        with system.open_input_file(place) as f:
            footer = pq.ParquetFile(f).metadata
    except (OSError, pa.ArrowInvalid, NotImplementedError):
        return None
    # The text's first line names an object in memory.
    stored = str(footer.schema).split("\n", 1)[1].encode()
    return hashlib.sha256(stored + b"\0" + (footer.metadata or {}).get(SPARK_SCHEMA, b"")).hexdigest()


def same_schema(spark: SparkSession, paths: Sequence[str], per_task: int = FILES_PER_TASK) -> list[list[str]]:
    """The paths in groups of equal stored schemas, groups and paths in the given order.

    One job, whatever the number of files: tasks read footers, and equal ones meet by their digest. One row for each
    distinct schema reaches the driver, with the places of its files, which the driver lists anyway.
    """
    if len(paths) == 1:
        return [list(paths)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [schema_key(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string())], names=["place", "key"])

    files = spark.createDataFrame(list(enumerate(paths)), "place int, path string")
    files = files.repartition(-(-len(paths) // per_task))
    keys = files.mapInArrow(read, "place int, key string")
    # Files that can't be told apart here are groups of their own.
    found = keys.groupBy(F.coalesce("key", F.concat(F.lit("#"), F.col("place")))).agg(F.sort_array(F.collect_list("place")).alias("places"))
    return [[paths[k] for k in r["places"]] for r in sorted(found.collect(), key=lambda r: r["places"][0])]
