"""Names and daily figures for labelled events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_count

# Counters of the daily figures.
COUNTERS = ["play_num", "like_num", "download_num", "share_num", "comment_num"]

# Fixed value: text for a missing name.
NO_NAME = "0"

# Fields of an event that stay beside the entity id.
EVENT_FIELDS = ["action", "keyword", "type", "timestamp", "dt", "position", "label", "order"]

ENTITY_KINDS = ["song", "singer", "album", "playlist"]


def add_names(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Name columns of an entity; missing ones become the text 0."""
    columns = [c for c in names.columns if c != key]
    joined = df.join(names, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NO_NAME)) for c in columns})


def log_stats(stats: DataFrame, counters: list[str] = COUNTERS) -> DataFrame:
    return stats.withColumns({c: log_count(F.col(c)) for c in counters})


def add_stats(df: DataFrame, stats: DataFrame, keys: list[str], counters: list[str] = COUNTERS) -> DataFrame:
    """Logged counters of the entity on the day of the event; missing ones become zero."""
    joined = df.join(log_stats(stats, counters).select(*keys, *counters), keys, "left")
    return joined.fillna(0.0, subset=counters)


def enrich(events: DataFrame, kind: str, names: DataFrame, stats: DataFrame) -> DataFrame:
    """Events of one entity kind with the names and daily figures of that entity.

    ``names`` and ``stats`` are keyed by a column called like the kind; ``stats`` also by
    ``dt``. The ids of the other entity kinds are left out of the result.
    """
    routed = events.where(F.col("type") == kind).select("user", kind, *EVENT_FIELDS)
    named = add_names(routed, names, kind)
    whole = add_stats(named, stats, [kind, "dt"])
    labels = [c for c in names.columns if c != kind]
    return whole.select("user", kind, *EVENT_FIELDS, *labels, *COUNTERS)
