"""Document quality by a convolutional network over bytes.

Filters of ``WIDTH`` bytes slide over the whole text. What they answer is cut into chunks of
``CHUNK`` places that overlap by half and together cover the document; each chunk keeps the greatest
answer of every filter. A document is described by the mean and the greatest of its chunks'
answers, which one logistic unit turns into a probability. As bytes are symbols, a filter is a table
of one weight per place and byte, and its answer at a place is a sum of looked-up weights; so the
gradient of a chunk touches only the bytes at the place where a filter answered most.

The network is fitted with numpy on a bounded sample of labelled rows (``SAMPLE_ROWS`` rows of at
most ``SAMPLE_BYTES`` bytes, those with the least hash of the id), of which a fifth decides when to
stop. Every document is scored whole, by arrays of a few thousand places at a time, so a long one
takes no more memory than its own bytes.

Defined cases: a missing or empty text is a row of padding and has a score as any other; rows
without an id are scored, belong to no fold that learns, and are held out; a document with several
labels counts once per label; rows without a label are only scored; without labels of both kinds
every score is the share of good labels, or 0.5 if there is none; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Filters, bytes that a filter sees, places of a chunk, and places that are worked on together.
FILTERS, WIDTH, CHUNK, PLACES = 32, 8, 256, 8_192

HALF = CHUNK // 2

# Bounds of the training sample, steps, steps between looks at the loss, documents of a step, learning rate, decay.
SAMPLE_ROWS, SAMPLE_BYTES, STEPS, LOOK, STEP_ROWS, RATE, DECAY = 3_000, 16_384, 1_500, 100, 16, 0.004, 1e-4

# Fixed value: from this score on a document counts as good.
GOOD = 0.7


@dataclass
class Net:
    """Weights by place and byte, and bias, of the filters; weights of means and maxima; bias."""

    table: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.shift, self.mean, self.most, self.bias]


def halves_of(n: int) -> int:
    """Half chunks of a text of ``n`` bytes and the padding behind it."""
    return -(-(n + WIDTH - 1) // HALF)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each padded with zero bytes to whole half chunks, and their numbers of halves.

    A window ends at its place. As padding stands before the first text and behind each of them, no
    window sees two texts.
    """
    sizes = np.array([halves_of(len(t)) for t in texts])
    joined = b"".join([t.ljust(int(n) * HALF, b"\0") for t, n in zip(texts, sizes)])
    return np.frombuffer(bytes(WIDTH - 1) + joined, np.uint8), sizes


def answers(net: Net, data: np.ndarray) -> np.ndarray:
    """Answer of every filter at every place."""
    n = len(data) - WIDTH + 1
    out = net.table[0].take(data[:n], axis=0)
    for w in range(1, WIDTH):
        out += net.table[w].take(data[w : w + n], axis=0)
    return out


def half_maxima(net: Net, data: np.ndarray) -> np.ndarray:
    """Greatest answer of every filter in every half chunk."""
    n = (len(data) - WIDTH + 1) // HALF
    out = np.empty((n, net.table.shape[2]), np.float32)
    step = PLACES // HALF
    for at in range(0, n, step):
        end = min(at + step, n)
        part = answers(net, data[at * HALF : end * HALF + WIDTH - 1])
        out[at:end] = part.reshape(end - at, HALF, -1).max(axis=1)
    return out


def _chunks(halves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of two neighbouring halves of one text: greatest answers, the half they come from, chunks per text."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = np.maximum(sizes - 1, 1)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    second = np.minimum(first + 1, np.repeat(starts + sizes - 1, counts))
    later = halves[second] > halves[first]
    return np.where(later, halves[second], halves[first]), np.where(later, second[:, None], first[:, None]), counts


def pooled(net: Net, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and greatest of the chunks' answers of every text."""
    top, _, counts = _chunks(half_maxima(net, data), sizes)
    top = np.maximum(top + net.shift, 0)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(top, starts) / counts[:, None], np.maximum.reduceat(top, starts)


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    mean, most = pooled(net, *padded(texts))
    logits = ((mean * net.mean).sum(axis=1) + (most * net.most).sum(axis=1) + net.bias[0]).astype(np.float64)
    return np.exp(-np.logaddexp(0.0, -logits))


def gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log loss of a step's texts and its gradient for every weight."""
    data, sizes = padded(texts)
    part = answers(net, data).reshape(-1, HALF, net.table.shape[2])
    places = part.argmax(axis=1)
    halves = np.take_along_axis(part, places[:, None], axis=1)[:, 0]
    top, source, counts = _chunks(halves, sizes)
    raw = top + net.shift
    top = np.maximum(raw, 0)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    mean, most = np.add.reduceat(top, starts) / counts[:, None], np.maximum.reduceat(top, starts)
    logits = mean @ net.mean + most @ net.most + net.bias[0]
    chance = 1 / (1 + np.exp(-logits))
    loss = float(np.logaddexp(0, np.where(labels, -logits, logits)).mean())
    slope = ((chance - labels) / len(labels)).astype(np.float32)
    text = np.repeat(np.arange(len(sizes)), counts)
    # Only the first chunk that answers most passes the slope of the maximum on.
    first = np.zeros_like(top)
    for i, (at, n) in enumerate(zip(starts, counts)):
        first[at + top[at : at + n].argmax(axis=0), np.arange(top.shape[1])] = slope[i]
    back = ((slope / counts)[text][:, None] * net.mean + first * net.most) * (raw > 0)
    by_half = np.zeros_like(halves)
    filters = np.broadcast_to(np.arange(top.shape[1]), top.shape)
    np.add.at(by_half, (source, filters), back)
    table = np.zeros_like(net.table)
    rows, columns = np.nonzero(by_half)
    at = rows * HALF + places[rows, columns]
    for w in range(WIDTH):
        np.add.at(table[w], (data[at + w], columns), by_half[rows, columns])
    return loss, [table, back.sum(axis=0), slope @ mean, slope @ most, np.array([slope.sum()], np.float32)]


def fresh(seed: int) -> Net:
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
    ends = draw.normal(0, FILTERS**-0.5, (2, FILTERS)).astype(np.float32)
    return Net(table, np.zeros(FILTERS, np.float32), ends[0], ends[1], np.zeros(1, np.float32))


def _loss(net: Net, texts: list[bytes], labels: np.ndarray) -> float:
    chance = np.clip(np.concatenate([probabilities(net, texts[i : i + 64]) for i in range(0, len(texts), 64)]), 1e-7, 1 - 1e-7)
    return float(-np.log(np.where(labels, chance, 1 - chance)).mean())


def train(texts: list[bytes], labels: np.ndarray, seed: int = 3, steps: int = STEPS) -> Net:
    """Adam steps over the sample in drawn orders; the weights with the least loss on every fifth text win."""
    net = fresh(seed)
    if labels.all() or not labels.any():
        share = (labels.sum() + 1e-3) / (len(labels) + 2e-3)
        return Net(net.table, net.shift, net.mean * 0, net.most * 0, np.array([np.log(share / (1 - share))], np.float32))
    watched = np.arange(len(texts)) % 5 == 4
    told = np.flatnonzero(~watched)
    judge = np.flatnonzero(watched) if watched.any() else told
    judged = [texts[i] for i in judge], labels[judge]
    draw = np.random.default_rng(seed + 1)
    order = np.zeros(0, np.int64)
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    best, least = net, np.inf
    for step in range(1, steps + 1):
        if len(order) < STEP_ROWS:
            order = np.concatenate([order, draw.permutation(told)])
        chosen, order = order[:STEP_ROWS], order[STEP_ROWS:]
        _, grads = gradients(net, [texts[i] for i in chosen], labels[chosen])
        rate = RATE * (1 - (step - 1) / steps)
        scale = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for value, grad, m, v in zip(net.parts(), grads, first, second):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= scale * m / (np.sqrt(v) + 1e-8) + rate * DECAY * value
        if (step % LOOK == 0 or step == steps) and (loss := _loss(net, *judged)) < least:
            best, least = Net(*[p.copy() for p in net.parts()]), loss
    return best


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: one in four, by the CRC-32 of the id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], np.ndarray]:
    """At most about ``rows`` labelled texts, drawn by the hash of their id, in the order of it."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    draw = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1 << 40))
    n = known.count()
    some = known.where(draw < int((1 << 40) * min(1.0, rows / max(n, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = texts.where(F.octet_length("text") <= SAMPLE_BYTES)
    found = texts.join(some, "doc_id").select(draw.alias("draw"), "doc_id", "good", "text")
    sample = sorted((r["draw"], r["doc_id"], r["good"], bytes(r["text"])) for r in found.collect())
    return [s[3] for s in sample], np.array([s[2] for s in sample], bool)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Net:
    return train(*training_sample(docs, labels, rows))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                yield {"doc_id": part.column("doc_id"), "score": probabilities(net, part.column("text").to_pylist())}

    scored = map_batches(rows, work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
