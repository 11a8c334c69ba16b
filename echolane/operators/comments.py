"""Comments of one country's users that got a reply, by kind of recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MEDIA_TYPES, not_robot, not_self


def active_users(users: DataFrame, country: str | int) -> DataFrame:
    """Distinct people of a country, robots left out."""
    rows = users.where(F.col("country_code") == country).where(not_robot(F.col("user_id")))
    return rows.select("user_id", "country_code").distinct()


def top_level(comments: DataFrame) -> DataFrame:
    return comments.where(F.col("parent_id") == 0)


def replied_ids(comments: DataFrame) -> DataFrame:
    """Ids of comments that somebody replied to."""
    return comments.where(F.col("parent_id") != 0).select(F.col("parent_id").alias("id")).distinct()


def media_in(recordings: DataFrame, types: list[int] = MEDIA_TYPES) -> DataFrame:
    return recordings.where(F.col("media_type").isin(types))


def members(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is listed. The list need not be distinct, and is never copied in full
    to the executors unless its measured size is small."""
    return df.join(keys, on, "left_semi")


def split_by_membership(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def replied_openers(comments: DataFrame) -> DataFrame:
    """Top-level comments with at least one reply."""
    return members(top_level(comments), replied_ids(comments), "id")


def comment_groups(
    users: DataFrame, openers: DataFrame, replied: DataFrame, recordings: DataFrame, types: list[int] = MEDIA_TYPES
) -> DataFrame:
    """``media_type, id, user_id, recording_id, comment`` of all groups in one plan.

    ``openers`` are top-level comments, ``replied`` the ids with a reply and ``users`` the
    wanted commenters. Comments on one's own recording are left out.
    """
    wanted = members(members(openers, users.select("user_id"), "user_id"), replied, "id")
    media = media_in(recordings, types).select(
        F.col("id").alias("recording_id"), F.col("user_id").alias("owner"), "media_type"
    )
    others = wanted.join(media, "recording_id").where(not_self(F.col("user_id"), F.col("owner")))
    return others.select("media_type", "id", "user_id", "recording_id", "comment")
