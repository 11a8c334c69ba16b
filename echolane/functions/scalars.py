"""Small column rules of the log and comment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids with this number above bit 48 belong to robots.
ROBOT_PREFIX, ROBOT_SHIFT = 5, 48

# Recording kinds that have comment groups of their own
# (solo audio, solo video, started duet audio/video, joined duet audio/video).
MEDIA_TYPES = [1, 2, 5, 6, 7, 8]

# Plural search types and their singular; any other type stays as it is.
SINGULAR_TYPE = {"songs": "song", "albums": "album", "singers": "singer"}

# Fixed value: stands for a missing id.
MISSING_ID = -1

DAY_FORMAT = "yyyyMMdd"


def not_robot(user_id: Column) -> Column:
    return F.shiftright(user_id, ROBOT_SHIFT) != ROBOT_PREFIX


def not_self(user: Column, owner: Column) -> Column:
    """The two differ; a missing owner counts as different."""
    return ~user.eqNullSafe(owner)


def singular_type(kind: Column) -> Column:
    out = kind
    for plural, singular in SINGULAR_TYPE.items():
        out = F.when(kind == plural, singular).otherwise(out)
    return out


def null_ids(df: DataFrame, columns: list[str], value: int = MISSING_ID) -> DataFrame:
    return df.fillna(value, subset=columns)


def day_of(timestamp: Column) -> Column:
    """``yyyyMMdd`` text of a timestamp or date."""
    return F.date_format(timestamp, DAY_FORMAT)


def log_count(counter: Column) -> Column:
    """Natural log of counter + 1, zero where the counter is missing."""
    return F.coalesce(F.log1p(counter.cast("double")), F.lit(0.0))


def text_or_none(column: Column) -> Column:
    """Text of a value, the word None for a missing one, so that joined fields never shift."""
    return F.coalesce(column.cast("string"), F.lit("None"))


# A hash holds two draws of fifteen hex digits, so each is one of 2**60 numbers.
DRAWS, DRAWS_PER_HASH, DRAW_DIGITS = 1 << 60, 2, 15


def bucket(seed: int, *keys: Column, part: int = 0) -> Column:
    """A repeatable draw in 0 … 2**60-1 for a key: fifteen hex digits of an MD5, the first by default."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), part * DRAW_DIGITS + 1, DRAW_DIGITS), 16, 10).cast("long")


def draw_below(fraction: float, seed: int, *keys: Column) -> Column:
    """True for about ``fraction`` of all keys."""
    return bucket(seed, *keys) < int(round(fraction * DRAWS))
