"""One of every group of texts whose sets of word shingles are similar.

Every text has ``BANDS`` x ``ROWS`` least hashes over its shingles (MinHash). Texts of which all
hashes of a band agree meet there: at a similarity of 0.8 all but one pair in 20,000, more above.
Which of them are similar is decided by the shingles themselves, never by the hashes.

In every band the smallest text is compared with all others, then more of those that are left at a
time. What is similar to a smaller text goes and is compared no more, so a dense group costs
about as many comparisons as it has members. Only hashes meet in the bands; two texts travel for
each distinct pair. When all have been compared, no two texts that met and stayed are similar.

Defined cases: texts without words are similar to nothing; texts shorter than a shingle are one
shingle; equal rows (id and text) stay or go together; rows without an id come last; an empty table
gives none. All columns are kept and may have any names but those that begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, map_batches, materialise

# Least hashes of a band, bands; hashes of shingles to work on at a time.
ROWS, BANDS, SLICE = 5, 25, 4_096

# By how much the number of texts of a band that are compared with all others grows every round.
FASTER = 4

_LOWEST = -(1 << 63)
_KEY = ["__lost", "__id", "__place"]


def shingles(text: str, size: int) -> set[bytes]:
    words = lower_ascii(text).split()
    size = min(size, len(words))
    return set(map(b" ".join, zip(*(words[i:] for i in range(size))))) if words else set()


def similar(a: set[bytes], b: set[bytes], least: float) -> bool:
    shared = len(a & b)
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def bands(found: set[bytes]) -> np.ndarray:
    """One hash per band."""
    import xxhash

    draw = np.random.default_rng(1)
    flips, factors = draw.integers(1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(1)), np.uint64, len(found))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for begin in range(0, len(hashes), SLICE):
        least = np.minimum(least, ((hashes[begin : begin + SLICE] ^ flips) * factors).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * factors[0]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    place = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumns({"__lost": doc_id.isNull(), "__id": F.coalesce(doc_id, F.lit(_LOWEST).cast("long")), "__place": place})


def _banded(keyed: DataFrame, size: int) -> DataFrame:
    """``band, n`` and the key, for every text with words; ``n`` is its number of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingles(text, size) for text in batch.column("text").to_pylist()]
            some = np.flatnonzero([len(s) > 0 for s in sets])
            who = np.repeat(some, BANDS)
            yield {
                "band": np.concatenate([bands(sets[i]) for i in some]) if len(some) else [],
                "n": np.array([len(s) for s in sets], np.int64)[who],
            } | {name: batch.column(name).take(pa.array(who)).to_pylist() for name in _KEY}

    rows = keyed.select(F.coalesce("text", F.lit("")).alias("text"), *_KEY)
    return map_batches(rows, work, "band long, n long, __lost boolean, __id long, __place long")


def _met(rows: DataFrame) -> DataFrame:
    """Without the bands that hold one text only."""
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("band")
    return rows.join(shared, "band", "left_semi")


def _verified(pairs: DataFrame, keyed: DataFrame, size: int, least: float) -> DataFrame:
    """The larger keys of the pairs ``a, b`` that are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, first = None, set()
        for batch in batches:
            gone = []
            for i, (left, right) in enumerate(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())):
                if left != last:
                    last, first = left, shingles(left, size)
                if similar(first, shingles(right, size), least):
                    gone.append(i)
            rows = batch.take(pa.array(gone, pa.int64()))
            yield {name: rows.column(name) for name in _KEY}

    text = F.coalesce("text", F.lit(""))
    here = keyed.join(pairs.select("a.*").unionByName(pairs.select("b.*")).distinct(), _KEY, "left_semi")
    one = lambda name, side: here.select(F.struct(*_KEY).alias(name), text.alias(side)).dropDuplicates([name])
    both = pairs.join(one("a", "left"), "a").join(one("b", "right"), "b")
    return map_batches(both.select("b.*", "left", "right"), work, "__lost boolean, __id long, __place long").distinct()


def _gone(keyed: DataFrame, size: int, least: float) -> DataFrame:
    """Keys of the texts that are similar to a smaller one."""
    every = materialise(_banded(keyed, size), "bands")
    left, gone, many = materialise(_met(every), "met"), None, 1
    discard(every)
    while gone is None or not left.isEmpty():
        rows = left.select("band", F.struct(*_KEY).alias("b"), F.col("n").alias("n_b"))
        part = F.pmod(F.xxhash64("b"), F.lit(many))
        centres = materialise(rows.groupBy("band", part.alias("part")).agg(F.min(F.struct("b", "n_b")).alias("c")).select("band", F.col("c.b").alias("a"), F.col("c.n_b").alias("n_a")), "centres")
        close = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9
        pairs = rows.join(centres, "band").where((F.col("a") != F.col("b")) & close)
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        found = materialise(_verified(pairs, keyed, size, least), "similar")
        gone = found if gone is None else gone.unionByName(found)
        done = centres.select("band", "a.*")
        before, left = left, materialise(_met(left.join(done, ["band", *_KEY], "left_anti").join(found, _KEY, "left_anti")), "met")
        discard(before, centres, pairs)
        many *= FASTER
    return gone.distinct()


def drop_similar(docs: DataFrame, size: int, least: float) -> DataFrame:
    """The documents that are not similar to a smaller one, with all their columns."""
    keyed = _keyed(docs)
    return keyed.join(_gone(keyed, size, least), _KEY, "left_anti").select(*docs.columns)
