"""Context-tree weighting over bytes, as a language model that is counted, weighted and looked up.

A byte is eight binary decisions. For every decision there is a tree of contexts: the last 0, 1, …
``DEPTH`` bytes. A node's counts give a Krichevsky-Trofimov estimate; its weighted probability is the
mean of that estimate and the product of its children's weighted probabilities. From these follow
the weights with which all depths mix into the probability of a decision.

One pass counts all runs of ``DEPTH`` + 1 bytes and all words of the training documents. Trees are
worked out from the counts, in partitions by the last two context bytes; only the nodes of depth 0
and 1, of which there are at most 65,280 and 255, meet on the driver. That gives one log probability
per run of bytes that occurs anywhere. The second pass looks runs and words up: the most frequent
ones, up to a fixed number, travel with the job; all others meet their figures in a join, and as
they are rare no key of that join is hot.

Texts are lower-cased in A-Z. A text's probability is that of its bytes, each after the ones before
it, and of an end mark; before the first byte stand marks as well.

Defined cases: a missing text is an empty one and still has its end; a missing id counts as empty
text when documents are held out; equal rows get equal rows; without training documents every
decision has probability one half; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, map_batches, materialise, text_rows

# Bytes of context; a mark that no UTF-8 text holds stands before and after a text.
DEPTH, MARK = 5, 0xFF

# Most frequent words and runs that travel with the job.
HEAD_WORDS, HEAD_RUNS = 400_000, 1_000_000

# Texts counted at a time, bits that number them, and entries that a task gathers before it passes them on.
TEXTS, TEXT_BITS, GATHER = 500, 9, 400_000

HOLD_OUT_MOD, HOLD_OUT_REST = 7, 2

_COUNTS = "word binary, run long, trained long, n long"


def held_out(doc_id: int | None) -> bool:
    text = "" if doc_id is None else str(doc_id)
    return zlib.crc32(text.encode()) % HOLD_OUT_MOD == HOLD_OUT_REST


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at each byte and at each end mark, and its text's number."""
    lengths = np.array([len(t) for t in texts], np.int64)
    marks = bytes([MARK]) * DEPTH
    data = np.frombuffer(marks + marks.join(texts) + marks, np.uint8)
    starts = DEPTH + np.cumsum(lengths + DEPTH) - (lengths + DEPTH)
    who = np.repeat(np.arange(len(texts)), lengths + 1)
    first = np.cumsum(lengths + 1) - (lengths + 1)
    at = np.arange(len(who)) - first[who] + starts[who]
    run = np.zeros(len(data) - DEPTH, np.int64)
    for begin in range(DEPTH + 1):
        run <<= 8
        run |= data[begin : begin + len(run)]
    return run[at - DEPTH], who


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many there are of each."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(starts, append=len(keys))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    kinds, which = np.unique(keys, return_inverse=True)
    return kinds, np.stack([np.bincount(which, np.concatenate([p[1][i] for p in parts]), len(kinds)).astype(np.int64) for i in range(2)])


def _count(docs: DataFrame) -> DataFrame:
    """``word, run, trained, n``: words or runs with their counts in training and in all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words: tuple[Counter, Counter] = Counter(), Counter()
        runs: list[tuple[np.ndarray, np.ndarray]] = []

        def gathered() -> Iterator[dict]:
            for held, counted in enumerate(words):
                n = np.fromiter(counted.values(), np.int64, len(counted))
                yield {"word": list(counted), "run": pa.nulls(len(n)), "trained": n * (1 - held), "n": n}
                counted.clear()

        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                out = np.array([held_out(i) for i in part.column("doc_id").to_pylist()], bool)
                texts = [lower_ascii(t) for t in part.column("text").to_pylist()]
                for text, held in zip(texts, out.tolist()):
                    words[held].update(text.split())
                    words[held][b""] += 1
                found, who = runs_of(texts)
                # A run takes 48 bits; beside it stands whether the text is held out.
                keys, counts = _tally(found << 1 | out[who])
                starts = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
                each = [np.add.reduceat(x, starts) if len(starts) else x for x in (np.where(keys & 1, 0, counts), counts)]
                runs.append((keys[starts] >> 1, np.stack(each)))
                if sum(len(r[0]) for r in runs) > 4 * GATHER:
                    runs = [_merge(runs)]
                if len(words[0]) + len(words[1]) > GATHER:
                    yield from gathered()
        yield from gathered()
        if runs:
            kinds, counts = _merge(runs)
            yield {"word": pa.nulls(len(kinds)), "run": kinds, "trained": counts[0], "n": counts[1]}

    found = map_batches(text_rows(docs), work, _COUNTS)
    return found.groupBy("word", "run").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n"))


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the estimate of a whole sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive numbers, by Stirling's series from ten on."""
    shift, big = np.zeros(len(x)), x.astype(float).copy()
    for _ in range(10):
        small = big < 10
        shift[small] -= np.log(big[small])
        big[small] += 1
    return shift + (big - 0.5) * np.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)


def _decisions(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of 255 decisions each run's byte takes, by bit, and how it goes."""
    byte = run & 0xFF
    bits = np.arange(8)[:, None]
    return (1 << bits) | (byte >> (8 - bits)), byte >> (7 - bits) & 1


class _Level:
    """Nodes of one depth: counts, weighted probability, and the weight with which it stops there."""

    def __init__(self, run: np.ndarray, n: np.ndarray, depth: int, below: _Level | None, top: tuple | None = None):
        prefix, bit = _decisions(run)
        context = run >> 8 & (1 << 8 * depth) - 1
        key = (context << 8 | prefix).ravel()
        if top is None:
            self.nodes, self.which = np.unique(key, return_inverse=True)
            counts = np.tile(n, 8).astype(float)
            size = len(self.nodes)
            self.ones = np.bincount(self.which, counts * bit.ravel(), size)
            self.zeros = np.bincount(self.which, counts, size) - self.ones
            estimate = _kt(self.zeros, self.ones)
            if below is None:
                self.log, self.stop = estimate, np.ones(size)
            else:
                context_below = below.nodes >> 8
                parent = (context_below & (1 << 8 * depth) - 1) << 8 | below.nodes & 0xFF
                product = np.bincount(np.searchsorted(self.nodes, parent), below.log, size)
                self.log = math.log(0.5) + np.logaddexp(estimate, product)
                self.stop = np.exp(math.log(0.5) + estimate - self.log)
        else:
            self.which, (self.zeros, self.ones, self.stop) = key, top
        self.bit = bit.ravel()

    def mix(self, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of every decision, given that by the deeper levels."""
        zeros, ones, stop = self.zeros[self.which], self.ones[self.which], self.stop[self.which]
        here = (np.where(self.bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
        return here if deeper is None else stop * here + (1 - stop) * deeper


def _levels(run: np.ndarray, n: np.ndarray) -> list[_Level]:
    """From depth ``DEPTH`` up to depth 2."""
    levels: list[_Level] = []
    for depth in range(DEPTH, 1, -1):
        levels.append(_Level(run, n, depth, levels[-1] if levels else None))
    return levels


def _gather(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    parts = [[b.column(name).to_numpy(zero_copy_only=False) for name in names] for b in batches if b.num_rows]
    return [np.concatenate(columns) for columns in zip(*parts)] if parts else []


def _train(runs: DataFrame) -> DataFrame:
    """``run, value``: the log probability, base ten, of each run's last byte after the others."""
    # Nodes from depth 2 down have all their runs in one partition.
    dealt = runs.select("run", F.col("trained").alias("n")).repartition(F.shiftright("run", 8).bitwiseAND(0xFFFF))

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        columns = _gather(batches, "run", "n")
        if columns:
            level = _levels(*columns)[-1]
            yield {"node": level.nodes, "zeros": level.zeros, "ones": level.ones, "log": level.log}

    nodes = map_batches(dealt, upper, "node long, zeros double, ones double, log double")
    # Node: two context bytes and the decision; its parent keeps the nearer byte.
    parent = F.col("node").bitwiseAND(0xFFFF)
    rows = nodes.groupBy(parent.alias("node")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log"))).collect()
    zeros, ones, below = (np.zeros(1 << 16) for _ in range(3))
    for row in rows:
        zeros[row["node"]], ones[row["node"]], below[row["node"]] = row["zeros"], row["ones"], row["log"]
    tops = []
    for _ in range(2):
        estimate = _kt(zeros, ones)
        log = math.log(0.5) + np.logaddexp(estimate, below)
        tops.append((zeros, ones, np.exp(math.log(0.5) + estimate - log)))
        zeros, ones, below = (x.reshape(-1, 256).sum(axis=0) for x in (zeros, ones, log))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        columns = _gather(batches, "run", "n")
        if columns:
            run, n = columns
            levels = _levels(run, n) + [_Level(run, n, depth, None, top) for depth, top in zip((1, 0), tops)]
            chance = None
            for level in levels:
                chance = level.mix(chance)
            yield {"run": run, "value": np.log10(chance).reshape(8, -1).sum(axis=0)}

    return map_batches(dealt, lower, "run long, value double")


def _head(table: DataFrame, key: str, size: int) -> tuple[list, np.ndarray]:
    rows = table.orderBy(F.desc("n"), key).limit(size).select(key, "value").toArrow()
    return rows.column(key), rows.column("value").to_numpy()


def score(docs: DataFrame, head_words: int = HEAD_WORDS, head_runs: int = HEAD_RUNS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    counts = materialise(_count(docs), "counts")
    words = counts.where("word IS NOT NULL").select("word", "n", "trained", F.log10(F.col("trained") + 1).alias("value"))
    totals = words.agg(F.sum("trained").alias("tokens"), F.count_if(F.col("trained") > 0).alias("kinds")).first()
    train_tokens, kinds = totals["tokens"] or 0, totals["kinds"]
    runs = counts.where("run IS NOT NULL")
    values = materialise(_train(runs), "runs").join(runs.select("run", "n"), "run")
    values = materialise(values, "runs")
    # Words of the head that no training document holds have the figure 0.
    word_keys, word_values = _head(words, "word", head_words)
    run_keys, run_values = _head(values, "run", head_runs)
    run_keys = run_keys.to_numpy()
    order = np.argsort(run_keys)
    run_keys, run_values = run_keys[order], run_values[order]
    word_list = word_keys.to_pylist()

    def told(part: pa.RecordBatch, which: np.ndarray, **columns: np.ndarray | list) -> dict:
        """Rows of texts of this part; columns that are not given are null."""
        own = {name: part.column(name).take(pa.array(which)) for name in ("doc_id", "place")}
        return {name: pa.nulls(len(which)) for name in names} | own | columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = dict(zip(word_list, word_values.tolist()))
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                texts = [lower_ascii(t) for t in part.column("text").to_pylist()]
                size = len(texts)
                tokens = [[*t.split(), b""] for t in texts]
                lengths = [len(t) for t in tokens]
                flat = [w for t in tokens for w in t]
                who = np.repeat(np.arange(size), lengths)
                found = np.fromiter(map(table.get, flat, repeat(math.nan)), float, len(flat))
                rare = np.flatnonzero(np.isnan(found))
                found[rare] = 0
                known = np.bincount(who, found > 0, size).astype(np.int64)
                base = np.bincount(who, found, size)
                # A run takes 48 bits; beside it stands its text. In order, neighbours are looked up in one place.
                keys, times = _tally((lambda run, of: run << TEXT_BITS | of)(*runs_of(texts)))
                run, of = keys >> TEXT_BITS, keys & (1 << TEXT_BITS) - 1
                at = np.minimum(np.searchsorted(run_keys, run), max(len(run_keys) - 1, 0))
                hit = run_keys[at] == run if len(run_keys) else np.zeros(len(run), bool)
                model = np.bincount(of[hit], times[hit] * run_values[at[hit]], size)
                rare_words = Counter(zip(who[rare].tolist(), map(flat.__getitem__, rare.tolist())))
                yield told(part, np.arange(size), n=np.ones(size, np.int64), n_tokens=lengths, n_known=known, base=base, model=model)
                yield told(part, np.array([d for d, _ in rare_words], np.int64), word=[w for _, w in rare_words], n=list(rare_words.values()))
                yield told(part, of[~hit], run=run[~hit], n=times[~hit])

    names = ("doc_id", "place", "word", "run", "n", "n_tokens", "n_known", "base", "model")
    schema = "doc_id long, place long, word binary, run long, n long, n_tokens long, n_known long, base double, model double"
    rows = text_rows(docs).select("doc_id", "text", F.xxhash64("text").alias("place"))
    rows = materialise(map_batches(rows, work, schema), "scores")
    whole = rows.where("n_tokens IS NOT NULL").select("doc_id", "place", F.col("n").alias("copies"), "n_tokens", "n_known", "base", "model")
    nothing, zero = F.lit(0).cast("long"), F.lit(0.0)
    by_word = rows.where("word IS NOT NULL").select("doc_id", "place", "word", F.col("n").alias("times"))
    by_word = by_word.join(words.select("word", "trained", "value"), "word").select(
        "doc_id", "place", nothing.alias("copies"), nothing.alias("n_tokens"), F.when(F.col("trained") > 0, F.col("times")).otherwise(nothing).alias("n_known"), (F.col("times") * F.col("value")).alias("base"), zero.alias("model")
    )
    by_run = rows.where("run IS NOT NULL").select("doc_id", "place", "run", F.col("n").alias("times"))
    by_run = by_run.join(values.select("run", "value"), "run").select(
        "doc_id", "place", nothing.alias("copies"), nothing.alias("n_tokens"), nothing.alias("n_known"), zero.alias("base"), (F.col("times") * F.col("value")).alias("model")
    )
    every = whole.unionByName(by_word).unionByName(by_run)
    sums = every.groupBy("doc_id", "place").agg(*(F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "model")))
    # Equal rows were summed up together and come apart again.
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    each = [F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_known")]
    share = math.log10(train_tokens + kinds + 1)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HOLD_OUT_MOD == HOLD_OUT_REST
    base = F.col("base") / F.col("copies") - F.expr("n_tokens div copies") * F.lit(share)
    return sums.select(
        "doc_id", out.alias("held_out"), *each, F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") / F.col("copies")).alias("score")
    )
