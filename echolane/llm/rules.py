"""Quality rules: fixed rules and an isolation forest on rule statistics.

Every text becomes six shares: characters a word, symbols, capitals, repeated lines, repeated words
and marks. A forest of random splits is grown on a bounded sample of rows labelled good. A split
picks any share and any place in the range that labelled rows of both kinds span, or a quarter of it
beyond, whether rows lie there or not, so ordinary documents end deep in crowded cells, and what differs from them in any
share, or in an odd mix of several, leaves early into an empty one. No share has a limit of its own.

How odd a kept document may be is read off labelled rows: the threshold is the score that all but
``max_loss`` of the rows labelled good stay below. Labelled rows are dealt by a hash of their id: one
half may be sampled for the forest, all rows of the other half set the threshold, by one aggregate of
their scores. Only the bounded sample reaches the driver. Every document is scored.

Defined cases: a missing text is an empty one, which the rules reject; equal rows get equal rows, and
rows with the threshold's own score are kept; very long texts are counted whole; labels without an id
or for unknown documents do nothing; of sampled rows with one id the one with the smallest counts is
taken; without labelled good rows the forest rejects nothing; an empty table gives none.
``filter_quality`` keeps all columns, whatever their names, and decides each row by its own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_batches, text_rows

# Characters that count as symbols, and the rules' limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

# Labelled rows of each kind, about, that the forest is grown on. A share counts as many further
# words of an ordinary text, so that few words or lines make no extreme one.
SAMPLE_ROWS = 8_192
EXTRA_WORDS, WORD_CHARS, LINE_WORDS = 20, 5, 5

# How far beyond the range of labelled rows splits may lie, in such ranges.
BEYOND = 0.25

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MARKS = "!?.,;:"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (codes[i : i + n] ^ (codes[i : i + n] >> np.uint64(31)))
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), bool)
    for place in range(window):
        covered[place : place + n] |= counts[which] > 1
    return int(covered.sum())


def statistics(text: str) -> list[float]:
    """The counts, then capital letters, marks and lines with a word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    spaces = sum(map(text.count, SPACES))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return [
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        _capitals(text),
        sum(map(text.count, MARKS)),
        len(lines),
    ]


def _capitals(text: str) -> int:
    """Characters that change when the text is made lower case."""
    data, small = text.encode("utf-8", "surrogatepass"), text.lower().encode("utf-8", "surrogatepass")
    if len(data) != len(small):
        return sum(a != b for a, b in zip(text, text.lower()))
    return int((np.frombuffer(data, np.uint8) != np.frombuffer(small, np.uint8)).sum())


def features(rows: np.ndarray) -> np.ndarray:
    """Shares that don't grow with a text's length, from rows of ``statistics``."""
    words, chars, symbols, dup_lines, repeats, capitals, marks, lines = rows.T.astype(float)
    some, letters = words + EXTRA_WORDS, chars + EXTRA_WORDS * WORD_CHARS
    return np.column_stack([letters / some, symbols / letters, dup_lines / (lines + EXTRA_WORDS / LINE_WORDS), repeats / some, capitals / letters, marks / some])


def base_failed(rows: np.ndarray) -> np.ndarray:
    words, repeats = rows[:, 0], rows[:, 4]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def _average_path(n: int) -> float:
    """Mean depth of a failed search among ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays with one row per tree: a leaf points at itself."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    height: int
    scale: float

    @classmethod
    def grow(cls, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, rows_per_tree: int = 1_600, height: int = 24, seed: int = 1) -> Forest:
        """Splits lie anywhere between ``low`` and ``high``, also where there are no rows."""
        draw = np.random.default_rng(seed)
        take = min(rows_per_tree, len(rows))
        grown = [cls._tree(rows[draw.choice(len(rows), take, replace=False)] if take else rows, low, high, height, draw) for _ in range(trees)]
        size = max(map(len, grown), default=1)
        feature, split, left, right, path = (
            np.array([[node[field] for node in tree] + [0] * (size - len(tree)) for tree in grown], kind)
            for field, kind in enumerate([np.int64, float, np.int64, np.int64, float])
        )
        return cls(feature, split, left, right, path, height, _average_path(take) or 1.0)

    @staticmethod
    def _tree(rows: np.ndarray, low: np.ndarray, high: np.ndarray, height: int, draw: np.random.Generator) -> list[tuple]:
        """``feature, split, left, right, path`` of every node."""
        nodes, todo = [()], [(0, rows, low, high, 0)]
        while todo:
            node, here, low, high, depth = todo.pop()
            if depth == height or len(here) <= 1:
                nodes[node] = (0, 0.0, node, node, depth + _average_path(len(here)))
                continue
            f = int(draw.integers(len(low)))
            at = draw.uniform(low[f], high[f])
            below = here[:, f] <= at
            upper, lower = high.copy(), low.copy()
            upper[f] = lower[f] = at
            left, right = len(nodes), len(nodes) + 1
            nodes[node] = (f, at, left, right, 0.0)
            nodes += [(), ()]
            todo += [(left, here[below], low, upper, depth + 1), (right, here[~below], lower, high, depth + 1)]
        return nodes

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; the fewer splits set a row apart, the higher."""
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for tree in range(len(self.path)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.height):
                below = rows[index, self.feature[tree, node]] <= self.split[tree, node]
                node = np.where(below, self.left[tree, node], self.right[tree, node])
            total += self.path[tree, node]
        return np.exp2(-total / max(len(self.path), 1) / self.scale)


@dataclass
class Model:
    forest: Forest
    threshold: float

    def verdicts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Statistics, base verdicts, scores and whether each text is kept."""
        rows = np.array([statistics(text) for text in texts]).reshape(len(texts), 8)
        failed, scores = base_failed(rows), self.forest.score(features(rows))
        return rows, failed, scores, ~failed & (scores <= self.threshold)


_ALL = [*COUNTS, "capitals", "marks", "lines"]


def _labelled(labels: DataFrame, half: int) -> DataFrame:
    """``doc_id, good`` of one half of the labelled rows."""
    rows = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half)


def _sample(docs: DataFrame, ids: DataFrame, rows: int) -> np.ndarray:
    """Statistics of about ``rows`` documents among ``ids``, by a hash of the id; none of those that the base rules reject."""
    steps = 1 << 20
    key = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(steps))
    share = min(1.0, rows / max(ids.count(), 1))
    picked = [r["doc_id"] for r in ids.where(key < int(share * steps)).distinct().collect()]
    if not picked:
        return np.zeros((0, 8))
    texts = text_rows(docs).where(F.col("doc_id").isin(picked))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = np.array([statistics(text) for text in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, 8)
            yield {"doc_id": batch.column("doc_id")} | dict(zip(_ALL, found.T))

    found = map_batches(texts, work, ", ".join(f"{name} long" for name in ["doc_id", *_ALL]))
    found = found.groupBy("doc_id").agg(F.min(F.struct(*_ALL)).alias("counts")).orderBy("doc_id")
    counts = np.array([tuple(r["counts"]) for r in found.collect()], dtype=float).reshape(-1, 8)
    return counts[~base_failed(counts)]


def fit(docs: DataFrame, labels: DataFrame, max_loss: float = 0.002, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Grow the forest on one half of ``labels`` (``doc_id, quality``), calibrate it on the other."""
    half = _labelled(labels, 0)
    good, bad = (features(_sample(docs, half.where(F.col("good") == kind).select("doc_id"), sample_rows)) for kind in (True, False))
    if not len(good):
        return Model(Forest.grow(good, np.zeros(6), np.ones(6), trees=0), math.inf)
    both = np.concatenate([good, bad])
    low, high = both.min(axis=0), both.max(axis=0)
    beyond = (high - low) * BEYOND
    model = Model(Forest.grow(good, low - beyond, high + beyond), math.inf)
    # Rows are judged where they lie; only ids and scores meet the labels.
    scored = judge(docs, model).where("NOT base_failed").select("doc_id", "score").join(_labelled(labels, 1), "doc_id")
    accuracy = F.lit(100_000)
    limits = scored.agg(
        F.percentile_approx(F.when(F.col("good"), F.col("score")), 1 - max_loss, accuracy).alias("good"),
        F.percentile_approx(F.when(~F.col("good"), F.col("score")), max_loss, accuracy).alias("bad"),
    ).first()
    if limits["good"] is None:
        return model
    # Where bad rows leave room, rows that are hardly odder than good ones are kept as well.
    least_bad = limits["good"] if limits["bad"] is None else limits["bad"]
    return Model(model.forest, max(limits["good"], (limits["good"] + least_bad) / 2))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """The counts, ``base_failed, kept, score`` of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows, failed, scores, kept = model.verdicts(batch.column("text").to_pylist())
            counts = dict(zip(COUNTS, rows.T))
            yield {"doc_id": batch.column("doc_id"), **counts, "base_failed": failed, "kept": kept, "score": scores}

    schema = ", ".join(["doc_id long", *(f"{name} long" for name in COUNTS), "base_failed boolean", "kept boolean", "score double"])
    return map_batches(text_rows(docs), work, schema)


def filter_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are kept, with all their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            yield batch.filter(pa.array(model.verdicts(texts)[3]))

    return docs.mapInArrow(work, docs.schema)
