"""Contiguous numbers and running totals over a total order, without a one-task window.

The frame is range-sorted and written once; every row then knows its sort partition and its
place in it. One figure per partition, kept in a literal array, turns that into a global
position, so that the numbering itself costs neither a join nor a second shuffle.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# A key with more than one in so many rows is hot.
SHARES = 1_000

_PLACE = "__place"
_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def _slot() -> Column:
    return F.shiftright(_PLACE, _SLOT_BITS).cast("int")


def _sorted_slots(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.sort(*order).withColumn(_PLACE, F.monotonically_increasing_id())
    return materialise(placed, "ordered")


def _before_slot(slots: DataFrame, total: Column) -> Column:
    """Sum of ``total`` over all sort partitions before that of the row."""
    rows = slots.groupBy(_slot().alias("slot")).agg(total.alias("total")).collect()
    sums = {row["slot"]: row["total"] or 0 for row in rows}
    by_slot = [sums.get(slot, 0) for slot in range(max(sums, default=0) + 1)]
    return F.lit([0, *accumulate(by_slot)][:-1]).cast("array<long>")[_slot()]


def with_index(df: DataFrame, order: list[Column], name: str = "index", start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, …`` in the given total order."""
    slots = _sorted_slots(df, order)
    inside = F.col(_PLACE).bitwiseAND((1 << _SLOT_BITS) - 1)
    before = _before_slot(slots, F.count(F.lit(1)))
    return slots.withColumn(name, inside + before + F.lit(start).cast("long")).drop(_PLACE)


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of the integer column ``value`` over all rows before each row in the given order."""
    slots = _sorted_slots(df, order)
    before = _before_slot(slots, F.sum(value))
    earlier = Window.partitionBy(_slot()).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return slots.withColumn(name, inside + before).drop(_PLACE)


def batch_index(df: DataFrame, order: list[Column], size: int, drop_tail: bool = False) -> DataFrame:
    """Assign rows to mini-batches of ``size``; a short last batch is kept or dropped."""
    numbered = with_index(df, order, "__row")
    if drop_tail:
        numbered = numbered.where(F.col("__row") < numbered.count() // size * size)
    return numbered.withColumn("batch", F.floor(F.col("__row") / size)).drop("__row")


def label_encode(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Number the sorted distinct values of ``column`` from 0."""
    return with_index(df.select(column).distinct(), [F.col(column).asc()], name)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; Spark cuts groups before the shuffle as well."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def heavy_from(df: DataFrame, column: str, most: int) -> int | None:
    """The least value of the positive integer ``column`` from which on there are at most ``most`` rows.

    Read off a histogram with eight steps per doubling, a few hundred rows at any size; so there may
    be fewer rows than ``most``, and none (None) where the highest step alone holds more.
    """
    step = F.floor(F.log2(column) * 8).cast("int").alias("step")
    rows = df.groupBy(step).agg(F.min(column).alias("least"), F.count(F.lit(1)).alias("n")).collect()
    least, room = None, most
    for row in sorted(rows, key=lambda r: -r["step"]):
        room -= row["n"]
        if room < 0:
            break
        least = row["least"]
    return least


def join_split(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on ``keys`` whose hot keys are measured first and dealt out to several tasks.

    A key of more than one in ``SHARES`` left rows is split into parts of about that size, and
    its right rows, one or a few per key, are repeated for each part: at most ``SHARES`` keys and twice
    as many parts. Left rows without a key match nothing and are spread as well.
    """
    known = [F.col(k).isNotNull() for k in keys]
    complete = reduce(lambda a, b: a & b, known)
    counts = left.where(complete).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counts = materialise(counts, "keys")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.where(F.col("__n") * SHARES > total).select(*keys, F.ceil(F.col("__n") * SHARES / max(total, 1)).cast("long").alias("__parts"))
    parts = F.when(complete, F.coalesce("__parts", F.lit(1))).otherwise(SHARES)
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts)).drop("__parts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - 1))
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("__part", each).drop("__parts")
    return dealt.join(copied, [*keys, "__part"], "left").drop("__part")
