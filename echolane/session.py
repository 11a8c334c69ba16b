"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the adaptive settings the operators count on.

    Adaptive execution decides from measured sizes which join side is broadcast and splits
    skewed join partitions, so the operators leave plain equi-joins without hints.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; without that setting it lies below
    the session's warehouse, which executors share as well.
    """
    path = spark.conf.get(_CHECKPOINT_KEY, None)
    if path:
        return path
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of what is written inside hold some ``size`` bytes, not just so many rows of any width."""
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_KEY)
        else:
            spark.conf.set(_BATCH_KEY, before)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when the write is done, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP_KEY, "false")
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_KEY, before)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, fixes the row placement for operators
    that need two passes over the same partitions, and gives the optimiser true file sizes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with passing_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folder = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialise`` wrote for these frames, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_folder", None)
        if path:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
