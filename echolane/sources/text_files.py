"""Readers for the delimited and line-oriented text inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field separators of the event files.
LABELLED_DELIMITER, EVENT_DELIMITER = "@cc@", "@+@"

# Fields of an event line and of a labelled event line.
EVENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "user", "song", "album", "playlist", "singer", "action", "keyword", "type", "timestamp", "dt", "order"
    )]
)
LABELLED_SCHEMA = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("user", "song", "album", "playlist", "singer")]
    + [T.StructField(name, T.StringType()) for name in ("action", "keyword", "type", "timestamp", "dt")]
    + [T.StructField(name, T.IntegerType()) for name in ("position", "label")]
    + [T.StructField("order", T.LongType())]
)

# Fixed value: users whose number in the id map is below this are kept.
USER_LIMIT = 10_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of a text corpus."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_delimited(spark: SparkSession, path: str, delimiter: str, schema: T.StructType) -> DataFrame:
    """Typed rows of a delimited file; lines of another width or with a failing cast are left out."""
    return parse_delimited(spark.read.text(path), delimiter, schema).where("ok").drop("ok")


def rejected_lines(spark: SparkSession, path: str, delimiter: str, schema: T.StructType) -> DataFrame:
    """How many lines ``read_delimited`` leaves out: one row with ``rejected``."""
    parsed = parse_delimited(spark.read.text(path), delimiter, schema)
    return parsed.agg(F.count_if(~F.col("ok")).alias("rejected"))


def parse_delimited(lines: DataFrame, delimiter: str, schema: T.StructType) -> DataFrame:
    """Split ``value`` into the schema's columns, with ``ok`` for lines that fit it."""
    fields = F.split(F.trim("value"), re.escape(delimiter), -1)
    rows = lines.select(fields.alias("fields"))
    casts = []
    fits = F.size("fields") == len(schema)
    for i, field in enumerate(schema):
        text = F.get("fields", F.lit(i))
        if isinstance(field.dataType, T.StringType):
            casts.append(text.alias(field.name))
        else:
            value = text.try_cast(field.dataType)
            fits = fits & value.isNotNull()
            casts.append(value.alias(field.name))
    return rows.select(*casts, fits.alias("ok"))


def read_impressions(spark: SparkSession, folder: str) -> DataFrame:
    """Impression shards: one row per shown item, ``uid, iid, click``.

    A line holds blank-separated fields; the first is the user, the second the shown items
    and the fifth the clicks, both as lists of equal length. Other lines are left out.
    """
    fields = F.split(F.trim("value"), " ")
    items, clicks = F.split(F.get("f", F.lit(1)), ","), F.split(F.get("f", F.lit(4)), ",")
    lists = spark.read.text(folder).select(fields.alias("f")).where(F.size("f") >= 5)
    lists = lists.select(F.col("f")[0].alias("uid"), items.alias("iid"), clicks.alias("click"))
    return explode_impressions(lists)


def explode_impressions(lists: DataFrame) -> DataFrame:
    """Two parallel lists of text, items and clicks, as integer rows."""
    both = lists.where(F.size("iid") == F.size("click"))
    rows = both.select("uid", F.explode(F.arrays_zip("iid", "click")).alias("pair"))
    rows = rows.select(
        "uid",
        F.col("pair.iid").try_cast("long").alias("iid"),
        F.col("pair.click").try_cast("int").alias("click"),
    )
    return rows.dropna(subset=["iid", "click"])


def read_id_map(spark: SparkSession, path: str, limit: int = USER_LIMIT) -> DataFrame:
    """Lines of ``(uid, number)``: the users whose number is below ``limit``."""
    pattern = r"^\s*\(\s*['\"]?([^,'\"]+?)[lL]?['\"]?\s*,\s*(\d+)[lL]?\s*\)\s*$"
    parts = spark.read.text(path).select(
        F.regexp_extract("value", pattern, 1).try_cast("long").alias("user_id"),
        F.regexp_extract("value", pattern, 2).try_cast("long").alias("number"),
    )
    return parts.where(F.col("number") < limit).dropna(subset=["user_id"])
