"""Day-partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DAY_FORMAT


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day_scan(df: DataFrame, day: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Some columns of one day of a table with a ``dt`` text partition."""
    rows = df.where(F.col("dt") == F.lit(day))
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns)


def trailing_days(df: DataFrame, day: str, n: int = 7) -> DataFrame:
    """The day and the ``n - 1`` days before it, as one range scan of the partitions."""
    last = F.to_date(F.lit(day), DAY_FORMAT)
    first = F.date_format(F.date_sub(last, n - 1), DAY_FORMAT)
    return df.where(F.col("dt").between(first, F.lit(day)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share out the rows of an input of few files by ``keys`` before costly per-row work.

    An input that already has a partition for every core is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
