"""From a week of search events to enriched training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import features as E
from ..operators import searchlog as L
from ..session import materialise
from ..sources.tables import trailing_days

WEEK = 7

# Names of the event columns in the raw log and after collection.
_RENAMED = {"user_id": "user", "song_id": "song", "album_id": "album", "playlist_id": "playlist", "singer_id": "singer"}


def collect_week(events: DataFrame, users: DataFrame, day: str, kind: str = "search") -> DataFrame:
    """The week's events of listed users, numbered, newest day first."""
    kept = L.collect_events(trailing_days(events, day, WEEK), users, kind).drop("type")
    kept = kept.withColumnsRenamed({**_RENAMED, "search_keyword": "keyword", "search_type": "type"})
    ties = [c for c in ("user", "song", "album", "playlist", "singer", "action", "keyword", "type")]
    return L.sequence_id(kept, *ties)


def label_week(collected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Search every distinct keyword once, then label what each event showed."""
    asked = collected.select("keyword", L.singular_type(collected["type"]).alias("type"))
    results = L.result_lists(L.keyword_search(asked, catalog))
    return L.label_impressions(collected, results)


def enrich_week(
    labelled: DataFrame, names: dict[str, DataFrame], stats: dict[str, DataFrame], day: str, days: int = WEEK
) -> dict[str, DataFrame]:
    """Per entity kind: training rows with names and the figures of the last days.

    The labelled rows are written once; each kind then reads its own.
    """
    labelled = materialise(labelled, "labelled")
    return {
        kind: E.enrich(labelled, kind, names[kind], trailing_days(stats[kind], day, days))
        for kind in E.ENTITY_KINDS
        if kind in names and kind in stats
    }
