"""From the day's tables to one folder of comments per kind of recording."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import comments as K
from ..sources.sinks import write_routed
from ..sources.tables import day_scan


def comments_of_day(users: DataFrame, comments: DataFrame, recordings: DataFrame, country: str, day: str) -> DataFrame:
    """Comments of a country's people that were replied to on the same day, one plan for all kinds."""
    people = K.active_users(day_scan(users, day, ["user_id", "country_code"]), country)
    today = day_scan(comments, day, ["id", "user_id", "recording_id", "parent_id", "comment"])
    media = day_scan(recordings, day, ["id", "user_id", "media_type"])
    return K.comment_groups(people, K.top_level(today), K.replied_ids(today), media)


def write_comments(groups: DataFrame, path: str) -> None:
    """The comment texts, one folder per kind, in one pass."""
    write_routed(groups, path, "media_type", line="comment")
