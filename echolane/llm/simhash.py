"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link at ``DISTANCE`` = 4 or fewer differing bits. A pair differs in at most
two of the left 31 bits or in at most one of the right 33. Anchors of either part are the words of
the Hamming code of length 31 (the right part's other two bits stand for themselves), so every
fingerprint has one anchor within radius 1, its home. It also visits every anchor within that
radius plus the part's threshold: 156 on the left, 17 or 18 on the right. Whichever of a linked pair is
at home at an anchor, the other one visits it, and they are compared there.

Equal fingerprints are one row from the start. At an anchor the homes come first and the visitors
stream past them; only links that join parts not yet joined there are passed on, so a dense group
gives about as many links as it has members at the anchor, not all its pairs. One anchor holds at
most one of the 170 or so rows of every fingerprint, which bounds what a dense group can put into
one task. Links are then contracted in rounds that are written out.

Defined cases: a missing text is an empty one; a text without words has fingerprint zero, which
links like any other; texts shorter than a shingle are one shingle; words keep their repeats. Rows
without an id get components like others but are never their smallest id. Equal rows get equal
rows; ``drop_near_copies`` keeps one of them. An empty table gives none. Extra columns stay as they
are in ``drop_near_copies`` and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, map_batches, materialise, text_rows

DISTANCE, BITS = 4, 64
SEED = 42

# The left part's and the right part's thresholds; a pair beyond both has 3 + 2 differing bits.
CODE_BITS, LEFT_MOST, RIGHT_MOST = 31, 2, 1

# Rows that are compared with each other at a time.
BLOCK = 1_024


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the hashes of all shingles, as a signed number."""
    import xxhash

    words = lower_ascii(text).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    n = len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, n, 1 << 16):
        part = hashes[begin : begin + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, place, bits`` of every document; place is a hash of the text that tells rows apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            bits = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "place": batch.column("place"), "bits": bits}

    rows = text_rows(docs).select("doc_id", "text", F.xxhash64("text").alias("place"))
    return map_batches(rows, work, "doc_id long, place long, bits long")


def hex_digits(bits: str = "bits"):
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Which bit to flip, counted from 1, to reach the code; 0 for a code word."""
    out = np.zeros(len(words), np.int64)
    for bit in range(5):
        mask = sum(1 << i for i in range(CODE_BITS) if (i + 1) >> bit & 1)
        out |= (np.bitwise_count(words & mask) & 1).astype(np.int64) << bit
    return out


def _flips(most: int) -> list[np.ndarray]:
    """For every syndrome, the flips of up to ``most`` bits that lead to a code word."""
    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for n in range(most + 1):
        for places in combinations(range(CODE_BITS), n):
            found[reduce(lambda x, y: x ^ y, (p + 1 for p in places), 0)].append(sum(1 << p for p in places))
    return [np.array(flips, np.int64) for flips in found]


def _reach(words: np.ndarray, flips: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code words reached from ``words``, and from which one each."""
    syndromes = _syndrome(words)
    code, source = [], []
    for syndrome in np.unique(syndromes):
        which = np.flatnonzero(syndromes == syndrome)
        code.append((words[which][:, None] ^ flips[syndrome][None, :]).ravel())
        source.append(np.repeat(which, len(flips[syndrome])))
    return np.concatenate(code), np.concatenate(source)


def _short(code: np.ndarray) -> np.ndarray:
    """The 26 bits that tell code words apart."""
    return code >> 2 & 1 | (code >> 4 & 7) << 1 | (code >> 8 & 0x7F) << 4 | (code >> 16 & 0x7FFF) << 11


def _keys(code: np.ndarray, rest: np.ndarray | None) -> np.ndarray:
    """Anchors as 32-bit numbers; those of the right part are negative."""
    return (_short(code) if rest is None else -1 - (rest << 26 | _short(code))).astype(np.int32)


def _split(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = bits.view(np.uint64)
    low = words & np.uint64((1 << 33) - 1)
    return (words >> np.uint64(33)).astype(np.int64), (low & np.uint64((1 << 31) - 1)).astype(np.int64), (low >> np.uint64(31)).astype(np.int64)


def homes(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home anchors of fingerprints in both parts, and the fingerprints."""
    left, right, rest = _split(bits)
    flip = _flips(1)
    # One flip or none leads to the code from anywhere.
    nearest = np.array([f[0] for f in flip])
    return np.concatenate([_keys(left ^ nearest[_syndrome(left)], None), _keys(right ^ nearest[_syndrome(right)], rest)]), np.tile(bits, 2)


def visits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors that fingerprints visit, their homes among them."""
    left, right, rest = _split(bits)
    code, source = _reach(left, _flips(1 + LEFT_MOST))
    keys, who = [_keys(code, None)], [source]
    code, source = _reach(right, _flips(1 + RIGHT_MOST))
    keys.append(_keys(code, rest[source]))
    who.append(source)
    # Differing bits outside the code leave fewer inside.
    code, source = _reach(right, _flips(RIGHT_MOST))
    for bit in (1, 2):
        keys.append(_keys(code, rest[source] ^ bit))
        who.append(source)
    return np.concatenate(keys), bits[np.concatenate(who)]


class _Anchor:
    """Homes of one anchor; visitors are compared with them in blocks."""

    def __init__(self, homes: np.ndarray):
        self.homes = homes
        self.part = np.arange(len(homes))

    def links(self, visitors: np.ndarray) -> Iterator[tuple[int, int]]:
        """A visitor's link to every part of the homes that it touches; these parts are one from then on."""
        if len(self.homes) * len(visitors) <= 16:
            pairs = ((h, v) for v in visitors.tolist() for h in self.homes.tolist() if h != v)
            yield from ((h, v) for h, v in pairs if ((h ^ v) & (1 << BITS) - 1).bit_count() <= DISTANCE)
            return
        for begin in range(0, len(visitors), BLOCK):
            block = visitors[begin : begin + BLOCK]
            near = np.concatenate(
                [np.bitwise_count((self.homes[h : h + BLOCK, None] ^ block[None, :]).view(np.uint64)) <= DISTANCE for h in range(0, len(self.homes), BLOCK)]
            )
            for column in np.flatnonzero(near.any(axis=0)):
                touched = np.flatnonzero(near[:, column])
                parts, first = np.unique(self.part[touched], return_index=True)
                for home in self.homes[touched[first]].tolist():
                    if home != block[column]:
                        yield home, int(block[column])
                if len(parts) > 1:
                    self.part[np.isin(self.part, parts)] = parts[0]


def _link_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Links from rows ``anchor, visitor, bits`` sorted by anchor, homes first."""
    key, known, anchor = None, [], None
    for batch in batches:
        keys = batch.column("anchor").to_numpy(zero_copy_only=False)
        visiting = batch.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
        bits = batch.column("bits").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        found: set[tuple[int, int]] = set()
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if begin == end:
                continue
            if keys[begin] != key:
                key, known, anchor = keys[begin], [], None
            here, guests = bits[begin:end][~visiting[begin:end]], bits[begin:end][visiting[begin:end]]
            if len(here):
                known.append(here)
            if len(guests):
                if anchor is None:
                    anchor = _Anchor(np.concatenate(known) if known else np.zeros(0, np.int64))
                if len(anchor.homes):
                    found.update((min(link), max(link)) for link in anchor.links(guests))
        a, b = zip(*found) if found else ((), ())
        yield {"a": a, "b": b}


def links(distinct: DataFrame) -> DataFrame:
    """``a < b``: enough linked pairs of the distinct fingerprints ``bits`` to join all that are linked."""

    def spread(distinct: DataFrame, places):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                bits = batch.column("bits").to_numpy(zero_copy_only=False)
                for begin in range(0, len(bits), BLOCK):
                    keys, who = places(np.ascontiguousarray(bits[begin : begin + BLOCK]))
                    yield {"anchor": keys, "bits": who}

        return map_batches(distinct.select("bits"), work, "anchor int, bits long")

    at_home = spread(distinct, homes)
    # A few bytes become many rows, so the rows are dealt out first. Most anchors that are visited are nobody's home.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    guests = spread(distinct.repartition(parts, "bits"), visits).join(at_home.select("anchor").hint("shuffle_hash"), "anchor", "left_semi")
    meeting = at_home.withColumn("visitor", F.lit(0)).unionByName(guests.withColumn("visitor", F.lit(1)))
    meeting = meeting.repartition("anchor").sortWithinPartitions("anchor", "visitor", "bits")
    return map_batches(meeting, _link_stream, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``a, b``: equal roots for connected nodes.

    Every round hooks each node to its smallest neighbour, follows the hooks and puts the nodes
    that meet together; links inside a part go, so the links shrink until none is left.
    """
    left, labels = materialise(links, "links"), None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root"))
        for _ in range(2):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            before, hooks = hooks, materialise(hooks.join(up, "root").select("node", F.col("up").alias("root")), "hooks")
            discard(before)
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        if labels is None:
            labels = materialise(hooks, "labels")
        else:
            old = labels
            labels = materialise(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
            discard(old)
        ends = left.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        ends = ends.join(hooks.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        before, left = left, materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(before, hooks)
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group_roots(marks: DataFrame) -> DataFrame:
    """``bits, root`` of every distinct fingerprint in ``marks``."""
    distinct = materialise(marks.select("bits").distinct(), "fingerprints")
    found = components(links(distinct)).withColumnRenamed("node", "bits")
    return distinct.join(found, "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"))


def near_copies(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    marks = materialise(fingerprints(docs, shingle).select("doc_id", "bits"), "marks")
    roots = materialise(group_roots(marks), "roots")
    firsts = marks.groupBy("bits").agg(F.min("doc_id").alias("first")).join(roots, "bits")
    smallest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    parts = roots.join(smallest, "root").select("bits", "component_id")
    return marks.join(parts, "bits").select("doc_id", hex_digits().alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int) -> DataFrame:
    """One document of every component, the one with the smallest id, with all its columns."""
    lowest = F.lit(-(1 << 63)).cast("long")
    # A missing id sorts last among the documents of a component.
    marks = materialise(fingerprints(docs, shingle).select(F.coalesce("doc_id", lowest).alias("__id"), F.col("doc_id").isNull().alias("lost"), "place", "bits"), "marks")
    members = marks.join(group_roots(marks), "bits")
    kept = members.groupBy("root").agg(F.min(F.struct("lost", F.col("__id"), "place")).alias("kept"))
    kept = kept.select(F.col("kept.__id").alias("__id"), F.col("kept.place").alias("__place"))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), lowest)).withColumn("__place", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(kept, ["__id", "__place"], "left_semi").dropDuplicates(["__id", "__place"]).select(*docs.columns)
