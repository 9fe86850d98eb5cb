"""Session and scratch-folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: Paths given out below the shared folder, by application.
_given: dict[str, set[str]] = {}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evenkeel")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        # Recording a Python call site per column expression slows the building of wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one is made only for a local master, and goes with the process."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="evenkeel-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, kept in mind for ``release``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands its Python workers batches of about so many bytes, by whole rows: Spark's 64 MB are held several times over,
    in the executor and in its workers. The session's own setting comes back afterwards."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder below the shared folder that no later plan reads."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _given.get(spark.sparkContext.applicationId, set()).discard(path)


def release(spark: SparkSession) -> int:
    """Delete every table that this application has written below the shared folder; returns how many.

    For the user to call once all results that were built from them are stored elsewhere: a lost executor's work is
    repeated from these tables, so nothing may still read them.
    """
    paths = list(_given.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        remove(spark, path)
    return len(paths)
