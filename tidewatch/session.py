"""Session settings the operators are written for.

A cluster supplies its own session; nothing here is required beyond a UTC session
time zone. The shuffle width is a start value only: AQE coalesces or splits it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the local bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidewatch")
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        **extra,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every machine of the session shares, for tables written between jobs.

    It is the one the cluster names in ``spark.checkpoint.dir``. A session in one process (tests,
    a laptop) may name none and then gets a folder of its own; a cluster without one is an error,
    as each executor would write to its own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatch-checkpoint-"))
    return context.getCheckpointDir()


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables that :func:`written` leaves inside the block; it goes when the block ends.

    For callers that have their answer, collected or written elsewhere, when they leave.
    """
    folder = f"{_SCRATCH.get() or shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, sort_by: tuple[str, ...] = ()) -> DataFrame:
    """The frame as a table of the shared folder, written once and read again.

    A lost executor then costs a read and no recomputation. Unlike an RDD checkpoint the rows are
    computed once and keep column pruning and sizes for the joins behind.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH.get() or shared_folder(spark)}/table-{uuid.uuid4().hex}"
    rows = df.sortWithinPartitions(*sort_by) if sort_by else df
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all cores, in front of work that is heavy for the bytes it reads.

    A table of a few MB is one split and one task, however long its rows take; AQE would put small
    partitions together again, so their number is given.
    """
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, 8))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame once and go on from the written rows."""
    return written(df)
