"""Periodic runs of words: stretches that repeat themselves at least three times.

A run is a stretch of consecutive words that repeats with a smallest period ``q``, is at least
``max(24, 3 q)`` words long and can't grow without losing that period. Periods up to ``SHORT`` come
from direct scans: words are compared with those ``q`` places later. Longer periods come from
minimizers at growing scales. A scale looks for the periods above ``low`` up to ``high``, takes the
hashes of all stretches of ``high`` words and keeps those that are least in some window of
``2 (low + 1) - high + 1`` hashes. Inside a run the choice repeats at period distance, as the
windows of one period stand again one period later, and no equal stretch of ``high`` words lies
nearer than the period; so the next equal minimizer is exactly one period away, and pairs of
neighbours among equal minimizers are all there is to try: no more of them than minimizers. Each
pair is a seed, extended word by word in both directions, and its period is tested against its
divisors. Hashes only propose; words decide.

Scales grow by 3/2 and 4/3 in turn up to a third of the longest text, and a scale only looks at
texts that are long enough for it. Documents are laid end to end, with a word of its own behind each
of them, so that one pass serves many short ones.

Defined cases: a missing or empty text has no words and no runs; rows without an id are kept; equal
rows are answered each; a text of any length is one row of its task, and needs some 100 bytes a word
there; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3

# Periods up to this are looked for at every place.
SHORT = 8

# Words that one pass takes together; a longer text makes a pass of its own.
PASS_WORDS = 400_000

SCHEMA = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary"

Rewrite = Callable[[int | None, int], "np.ndarray | None"]
Run = tuple[int, int, int]

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _ODD[0] + (right ^ (right >> np.uint64(31))) * _ODD[1]
    out ^= out >> np.uint64(32)
    out *= _ODD[2]
    return out ^ (out >> np.uint64(29))


def _joined(hashes: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of what two equally long stretches cover that start ``shift`` words apart."""
    return _mixed(hashes[: len(hashes) - shift], hashes[shift:])


def _window(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest value of every window, by running values inside blocks of ``size``."""
    n = len(values)
    edge = values[-1:]
    blocks = np.concatenate([values, np.repeat(edge, -n % size)]).reshape(-1, size)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - size + 1], ahead[size - 1 : n])


def _minimizers(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places whose hash is the least one of some window of ``size`` hashes."""
    least = _window(hashes, size, np.minimum)
    padding = np.zeros(size - 1, np.uint64)
    return np.flatnonzero(_window(np.concatenate([padding, least, padding]), size, np.maximum) == hashes)


def _first_false(same: Callable[[int, int], np.ndarray], end: int) -> int:
    """How many leading truths ``same(i, j)`` tells for places up to ``end``, in growing steps."""
    at, step = 0, 64
    while at < end:
        part = same(at, min(at + step, end))
        if not part.all():
            return at + int(np.argmin(part))
        at, step = at + len(part), step * 4
    return end


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _is_run(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether a stretch that repeats at ``period`` is long enough and has no smaller period."""
    if end - start < max(LEAST_WORDS, LEAST_PERIODS * period):
        return False
    shorter = (period // p for p in _prime_factors(period))
    return not any(np.array_equal(ids[start : end - d], ids[start + d : end]) for d in shorter)


def _scan(ids: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    same = np.zeros(len(ids) - period + 2, np.int8)
    same[1:-1] = ids[:-period] == ids[period:]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2]
    for i in np.flatnonzero(ends - starts + period >= max(LEAST_WORDS, LEAST_PERIODS * period)):
        yield int(starts[i]), int(ends[i]) + period


def _seeds(hashes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Neighbours among equal minimizers, ``low`` to ``high`` words apart: rows ``period, place``."""
    size = 2 * (low + 1) - high + 1
    if len(hashes) < size:
        return np.zeros((0, 2), np.int64)
    places = _minimizers(hashes, size)
    order = np.argsort(hashes[places], kind="stable")
    places, values = places[order], hashes[places[order]]
    apart = np.diff(places)
    good = np.flatnonzero((values[:-1] == values[1:]) & (apart > low) & (apart <= high))
    out = np.stack([apart[good], places[good]], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _extended(ids: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``start, end, period`` of the stretch around every seed; seeds inside a found one are passed over."""
    last, reach = 0, -1
    for period, place in seeds.tolist():
        if period == last and place < reach:
            continue
        right = _first_false(lambda i, j: ids[place + i : place + j] == ids[place + period + i : place + period + j], len(ids) - period - place)
        if not right:
            continue
        before = lambda i, j: ids[place - j : place - i][::-1] == ids[place + period - j : place + period - i][::-1]
        start = place - _first_false(before, place)
        last, reach = period, place + right
        yield start, reach + period, period


def _scales(most: int) -> Iterator[tuple[int, int]]:
    low, high = SHORT, SHORT * 3 // 2
    while low < most:
        yield low, high
        low, high = high, high * 4 // 3 if high % 3 == 0 else high * 3 // 2


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """Runs ``start, length, period`` of every sequence of word numbers, by start, then period."""
    out: list[set[Run]] = [set() for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    chosen = np.flatnonzero(sizes >= LEAST_WORDS)
    if not len(chosen):
        return [[] for _ in texts]
    words = 1 + max(int(texts[i].max()) for i in chosen)
    # A number of its own ends each text.
    ids = np.concatenate([np.append(texts[i], words + k) for k, i in enumerate(chosen)])
    hashes = np.random.default_rng(29).integers(0, 1 << 64, words + len(chosen), np.uint64, endpoint=False)[ids]

    def keep(found: Iterator[tuple[int, int, int]]) -> None:
        begins = np.concatenate([[0], np.cumsum(sizes[chosen] + 1)])
        for start, end, period in found:
            if _is_run(ids, start, end, period):
                k = int(np.searchsorted(begins, start, side="right")) - 1
                out[chosen[k]].add((start - int(begins[k]), end - start, period))

    for period in range(1, SHORT + 1):
        keep((s, e, period) for s, e in _scan(ids, period))
    width = 1
    while width < SHORT:
        hashes, width = _joined(hashes, width), width * 2
    for low, high in _scales(int(sizes.max()) // LEAST_PERIODS):
        long = sizes[chosen] >= LEAST_PERIODS * (low + 1)
        if not long.all():
            mask = np.repeat(long, sizes[chosen] + 1)
            ids, hashes, chosen = ids[mask], hashes[mask[: len(hashes)]], chosen[long]
        if not len(chosen):
            break
        if high % 3 == 0:
            keep(_extended(ids, _seeds(_joined(hashes, high - width), low, high)))
        else:
            hashes, width = _joined(hashes, width), width * 2
            keep(_extended(ids, _seeds(hashes, low, high)))
    return [sorted(found) for found in out]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay if of every run only the first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, starts, lengths, periods`` of the runs and the ``collapsed`` text of every document.

    ``rewrite(doc_id, n)`` may give the places of the words that a text is to consist of instead.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def passes(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, list[bytes]]]]:
        held, n = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            held.append((doc_id, text.as_py().split()))  # bytes split at ASCII white space alone
            n += len(held[-1][1])
            if n >= PASS_WORDS:
                yield held
                held, n = [], 0
        if held:
            yield held

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for held in passes(batch):
                numbers: dict[bytes, int] = {}
                texts, chosen = [], []
                for doc_id, words in held:
                    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                    places = rewrite(doc_id, len(words)) if rewrite else None
                    texts.append(ids if places is None else ids[places])
                    chosen.append(places)
                found = find_runs(texts)
                collapsed = []
                for (_, words), places, runs in zip(held, chosen, found):
                    if runs or places is not None:
                        order = np.arange(len(words)) if places is None else places
                        words = [words[i] for i in order[kept_words(len(words), runs)].tolist()]
                    collapsed.append(b" ".join(words))
                parts = {name: [[run[i] for run in runs] for runs in found] for i, name in enumerate(("starts", "lengths", "periods"))}
                yield {"doc_id": [d for d, _ in held], "n_words": [len(w) for _, w in held], **parts, "collapsed": collapsed}

    return map_batches(rows, work, SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the one with most periods, and digests of all runs and of the collapsed text."""
    runs = F.arrays_zip("starts", "lengths", "periods")
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("starts", "lengths", "periods")])
    text = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    # Lengths over periods as exact fractions; the first of equal ones has the smallest start and period.
    better = lambda a, b: a["lengths"] * b["periods"] > b["lengths"] * a["periods"]
    best = F.aggregate("runs", F.element_at("runs", 1), lambda a, b: F.when(better(b, a), b).otherwise(a))
    some = found.select("doc_id", F.col("n_words"), "collapsed", runs.alias("runs"))
    some = some.withColumn("best", F.when(F.size("runs") > 0, best))
    return some.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.starts").alias("start"),
        F.col("best.lengths").alias("length"),
        F.col("best.periods").alias("period"),
        F.floor(1000 * F.col("best.lengths") / F.col("best.periods")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document by the CRC-32 of its id: from some word on it repeats a few of its words."""
    import zlib

    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    places = np.arange(n)
    places[start:] = start + (places[start:] - start) % period
    return places
