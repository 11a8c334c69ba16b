"""Text, routed, CSV and vector outputs. Every one writes in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import text_or_none


def delimited_line(columns: list[str], delimiter: str):
    return F.concat_ws(delimiter, *[text_or_none(F.col(c)) for c in columns])


def write_delimited(df: DataFrame, path: str, delimiter: str) -> None:
    """One line per row; a missing value is written as None, so that no field shifts."""
    df.select(delimited_line(df.columns, delimiter).alias("value")).write.text(path)


def write_routed(df: DataFrame, path: str, by: str, line: str | None = None) -> None:
    """One folder per value of ``by``, all in one pass: parquet, or the text of one column."""
    if line is None:
        df.write.partitionBy(by).parquet(path)
    else:
        df.select(by, F.col(line).alias("value")).write.partitionBy(by).text(path)


def write_ranked_csv(df: DataFrame, path: str, score: str = "prob") -> None:
    """Rows by falling score, in parts that are in order from file to file."""
    df.orderBy(F.col(score).desc()).write.csv(path, header=True)


def save_vectors(df: DataFrame, path: str) -> None:
    """``id, word, vec`` for use by later jobs."""
    df.select("id", "word", F.col("vec").cast("array<double>").alias("vec")).write.parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, word string, vec array<double>").parquet(path)
