"""Benchmark items inside documents, up to a share of edited words.

Texts are sequences of words, in lower case and without punctuation. An item of ``n`` words with at
most ``k`` edited ones keeps, wherever the edits stand, ``(n - k) / (k + 1)`` words in a row as they
were, rounded up: four at 20 % edits, fewer in short items. The runs of that length at every place
of an item are looked up at every word of a document, so no leak is missed. As an edit spoils no
more runs than a run has words, long items must share several on nearby diagonals. Every candidate
is then verified by the exact edit distance of whole words, from every start that its runs allow.

Benchmarks are taken in blocks of a bounded number of words, one pass over the documents each, so
nothing that travels grows with them.

Defined cases: a missing text is an empty one; items and documents without words match nothing;
equal documents and equal items all get their rows; rows without an id keep null; empty tables give
none. ``drop_leaks`` keeps all columns, whatever their names, and decides each row by its own text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_rows

# Edited words per word of an item.
MAX_EDITS = 0.2

# Words of a block of items, texts to search at a time.
BLOCK_WORDS, TEXTS = 1_000_000, 500

_KEEP = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))

LEAKS = "doc_id long, item_id long, start_word long, n_words long, distance long"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


def most_edits(n: int, share: float = MAX_EDITS) -> int:
    return int(n * share + 1e-9)


def kept_run(n: int, most: int) -> int:
    """Words in a row that ``most`` edits leave as they were somewhere in an item of ``n`` words."""
    return -(-(n - most) // (most + 1))


def edit_distances(item: np.ndarray, windows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window, the least edits from ``item`` to a prefix of it, and that prefix's length; above ``most`` any number."""
    steps = np.arange(windows.shape[1] + 1)
    rows = np.tile(steps, (len(windows), 1))
    for i in range(len(item)):
        kept = np.empty_like(rows)
        kept[:, 0] = i + 1
        kept[:, 1:] = np.minimum(rows[:, :-1] + (windows != item[i]), rows[:, 1:] + 1)
        # Insertions run to the right: the least so far plus the steps since.
        rows = np.minimum.accumulate(kept - steps, axis=1) + steps
        if rows.min(initial=most + 1) > most:
            return np.full(len(windows), most + 1), np.zeros(len(windows), np.int64)
    ends = rows.argmin(axis=1)
    return rows[np.arange(len(rows)), ends], ends


def edit_distance(item: np.ndarray, words: np.ndarray, most: int) -> tuple[int, int]:
    distances, ends = edit_distances(item, words[None, : len(item) + most], most)
    return int(distances[0]), int(ends[0])


@dataclass
class Runs:
    """Sorted keys of all runs of ``length`` words, with the item and the place in it of each."""

    length: int
    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    marked: np.ndarray


class Index:
    """Runs of a block of items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], share: float = MAX_EDITS, seed: int = 1):
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.ids = [item_id for item_id, _ in items]
        self.items = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in items]
        self.factor = np.random.default_rng(seed).integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.most = np.array([most_edits(len(i), share) for i in self.items], np.int64)
        self.gap = int(self.most.max(initial=0)) + 1
        self.pad = max(map(len, self.items), default=0) + 2 * self.gap
        by_length = defaultdict(list)
        # Runs that an item shares with every leak of it at least: an edit spoils as many as a run has words.
        self.least = np.ones(len(self.items), np.int64)
        for number, (item, most) in enumerate(zip(self.items, self.most.tolist())):
            if len(item):
                length = max(1, kept_run(len(item), most))
                by_length[length].append(number)
                self.least[number] = max(1, len(item) - length + 1 - most * length)
        self.runs = []
        for length, numbers in sorted(by_length.items()):
            counts = [len(self.items[i]) - length + 1 for i in numbers]
            keys = np.concatenate([self._keys(self.items[i], length) for i in numbers])
            order = np.argsort(keys, kind="stable")
            places = np.concatenate([np.arange(n) for n in counts])
            marked = np.zeros(1 << 20, bool)
            marked[keys >> np.uint64(44)] = True
            self.runs.append(Runs(length, keys[order], np.repeat(numbers, counts)[order], places[order], marked))

    def _keys(self, words: np.ndarray, length: int) -> np.ndarray:
        """One key per run of ``length`` words."""
        n = len(words) - length + 1
        key = np.zeros(max(n, 0), np.uint64)
        for place in range(length if n > 0 else 0):
            key = (key ^ words[place : place + n].astype(np.uint64)) * self.factor
            key ^= key >> np.uint64(29)
        return key * self.factor

    def _candidates(self, words: np.ndarray, runs: Runs) -> Iterator[tuple[int, np.ndarray]]:
        """Items, each with the starts that a leak which shares enough runs may have."""
        n = len(words) - runs.length + 1
        if n <= 0:
            return
        known = np.concatenate([[0], np.cumsum(words > 0)])
        at = np.flatnonzero(known[runs.length :] - known[:-runs.length] == runs.length)
        key = self._keys(words, runs.length)[at]
        seen = runs.marked[key >> np.uint64(44)]
        at, key = at[seen], key[seen]
        first, end = (np.searchsorted(runs.keys, key, side=side) for side in ("left", "right"))
        counts = end - first
        place = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        # Diagonals of all hits, item by item, too far apart between items to be neighbours.
        items = runs.items[place]
        width = len(words) + 2 * self.pad
        hits = np.sort(items * width + np.repeat(at, counts) - runs.places[place] + self.pad)
        items = hits // width
        most = 2 * self.most[items]
        near = np.searchsorted(hits, hits + most, side="right") - np.searchsorted(hits, hits - most, side="left")
        hits = np.unique(hits[near >= self.least[items]])
        items = hits // width
        cuts = np.flatnonzero(np.diff(items)) + 1
        for begin, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hits)]):
            if begin < stop:
                number = int(items[begin])
                shifts = np.arange(-self.most[number], self.most[number] + 1)
                starts = np.unique(((hits[begin:stop] % width - self.pad)[:, None] + shifts).ravel())
                starts = starts[(starts >= 0) & (starts < len(words))]
                # What stands between texts is no start.
                yield number, starts[words[starts] >= 0]

    def _verify(self, words: np.ndarray, starts: np.ndarray, number: int) -> Iterator[tuple[int, int, int]]:
        """``start, n_words, distance`` of the windows that are close enough."""
        item, most = self.items[number], int(self.most[number])
        n = len(item)
        for begin in range(0, len(starts), TEXTS):
            here = starts[begin : begin + TEXTS]
            # All but the edited words of the item must stand near their place; both ends of the words are gaps.
            near = np.zeros((len(here), n), bool)
            for shift in range(-most, most + 1):
                places = np.clip(here[:, None] + np.arange(shift, n + shift), 0, len(words) - 1)
                near |= words[places] == item
            here = here[near.sum(axis=1) >= n - most]
            if not len(here):
                continue
            places = here[:, None] + np.arange(n + most)
            windows = np.where(places < len(words), words[np.minimum(places, len(words) - 1)], -1)
            distances, lengths = edit_distances(item, windows, most)
            close = distances <= most
            yield from zip(here[close].tolist(), lengths[close].tolist(), distances[close].tolist())

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``text, item, start, n_words, distance`` of every leak; of overlapping windows the closest."""
        ids, ends, parts = self.vocabulary, [], [np.full(self.gap, -1)]
        size = self.gap
        for text in texts:
            tokens = words_of(text)
            # Between texts stands what no item holds, more of it than may be edited.
            parts += [np.fromiter(map(ids.get, tokens, repeat(0)), np.int64, len(tokens)), np.full(self.gap, -1)]
            size += len(tokens)
            ends.append(size)
            size += self.gap
        if not self.runs or not texts:
            return []
        words = np.concatenate(parts)
        ends = np.array(ends)
        found = []
        for runs in self.runs:
            for number, starts in self._candidates(words, runs):
                for start, length, distance in self._verify(words, starts, number):
                    text = int(np.searchsorted(ends, start, side="right"))
                    begin = int(ends[text - 1]) + self.gap if text else self.gap
                    found.append((text, number, start - begin, length, distance))
        found.sort(key=lambda f: (f[0], f[1], f[4], f[2]))
        kept: list[tuple[int, int, int, int, int]] = []
        for leak in found:
            clash = (k for k in reversed(kept) if k[:2] == leak[:2] and k[2] < leak[2] + leak[3] and leak[2] < k[2] + k[3])
            if next(clash, None) is None:
                kept.append(leak)
        return [(text, self.ids[number], *rest) for text, number, *rest in sorted(kept)]


def blocks(benchmark: DataFrame, share: float = MAX_EDITS) -> Iterator[Index]:
    """Indexes of the items ``item_id, text``, each of at most about ``BLOCK_WORDS`` words."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        words = words_of(row["text"] or "")
        if items and size + len(words) > BLOCK_WORDS:
            yield Index(items, share)
            items, size = [], 0
        items.append((row["item_id"], words))
        size += len(words)
    yield Index(items, share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MAX_EDITS) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance`` of every leak."""

    def search(index: Index) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for begin in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(begin, TEXTS)
                    doc_ids = part.column("doc_id").to_pylist()
                    rows = [(doc_ids[text], *rest) for text, *rest in index.search(part.column("text").to_pylist())]
                    yield dict(zip(("doc_id", "item_id", "start_word", "n_words", "distance"), zip(*rows))) if rows else _NO_LEAKS

        return map_batches(text_rows(docs), work, LEAKS)

    found = None
    for index in blocks(benchmark, share):
        found = search(index) if found is None else found.unionByName(search(index))
    return found


_NO_LEAKS = {"doc_id": [], "item_id": [], "start_word": [], "n_words": [], "distance": []}


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MAX_EDITS) -> DataFrame:
    """The documents without any leak, with all their columns."""

    def clean(rows: DataFrame, index: Index) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(begin, TEXTS)
                    kept = np.ones(part.num_rows, bool)
                    kept[[text for text, *_ in index.search(pc.fill_null(part.column("text"), "").to_pylist())]] = False
                    yield part.filter(pa.array(kept))

        return rows.mapInArrow(work, rows.schema)

    for index in blocks(benchmark, share):
        docs = clean(docs, index)
    return docs
