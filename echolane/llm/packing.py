"""Pack token sequences into few rows of fixed length: large-item matching, then best fit.

Pieces above a third of the capacity pair at most twice per row: from the longest down, each takes
the longest other one that fits beside it. Smaller pieces, from the longest down, go where the gap
that stays is smallest. Both steps look at lengths alone, so the plan is made on the histogram of
lengths, which has at most ``capacity`` entries however many documents there are. It says which
numbers of which length go to which rows; every piece then finds its row from its length and its
number among the pieces of that length.

Defined cases: a missing text is an empty one and gives one piece, its end id; equal rows are packed
as rows of their own; an empty table gives none; other columns are not read. Pieces of the same
length are told apart by their document, piece and place, so retries give the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import with_index
from .common import map_batches, materialise, text_rows
from .tokens import TEXTS, Encoder

CAPACITY = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Cut ``n`` ids into full pieces; a rest goes first."""
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(vocabulary)
        last = np.array([end_id], dtype="<u4")
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
                tokens = encoder.encode(part.column("text").to_pylist())
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens):
                    data, start = np.concatenate([ids.astype("<u4"), last]).tobytes(), 0
                    for piece, length in enumerate(piece_lengths(len(ids) + 1, capacity)):
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        for name, value in zip(out, (doc_id, piece, start, length, crc)):
                            out[name].append(value)
                        start += length
                yield out

    return map_batches(text_rows(docs), work, PIECES)


class Plan:
    """Runs of equal pieces and the rows they go to.

    An entry ``(first, row, per_row, offset)`` of a length says: from number ``first`` on, pieces of
    that length fill rows from ``row`` on, ``per_row`` in each, the first of them at ``offset``.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.entries: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.rows = 0
        self._taken = dict.fromkeys(counts, 0)
        # Rows with a gap, as runs (first row, number of rows), by gap.
        self._open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        large = {length: n for length, n in counts.items() if 3 * length > capacity}
        self._match(large)
        for length in sorted((x for x in counts if x not in large), reverse=True):
            self._best_fit(length, counts[length])

    def _put(self, length: int, n: int, row: int, per_row: int, offset: int) -> None:
        self.entries[length].append((self._taken[length], row, per_row, offset))
        self._taken[length] += n

    def _new_rows(self, n: int) -> int:
        self.rows += n
        return self.rows - n

    def _match(self, left: dict[int, int]) -> None:
        lengths = sorted(left)
        while lengths:
            long = lengths[-1]
            at = bisect_left(lengths, self.capacity - long + 1) - 1
            if at < 0:  # nothing fits beside it
                n, short = left[long], None
            elif lengths[at] == long:
                n, short = left[long] // 2, long
                if not n:
                    n, short = 1, lengths[at - 1] if at else None
            else:
                short = lengths[at]
                n = min(left[long], left[short])
            row = self._new_rows(n)
            if short == long:
                self._put(long, 2 * n, row, 2, 0)
            else:
                self._put(long, n, row, 1, 0)
                if short is not None:
                    self._put(short, n, row, 1, long)
            self._open[self.capacity - long - (short or 0)].append((row, n))
            left[long] -= n
            if short is not None:
                left[short] -= n
            lengths = [x for x in lengths if left[x]]

    def _best_fit(self, length: int, n: int) -> None:
        gaps = sorted(gap for gap, runs in self._open.items() if gap >= length and runs)
        for gap in gaps:
            per_row = gap // length
            while n and self._open[gap]:
                row, rows = self._open[gap].pop()
                used = min(rows, -(-n // per_row))
                if used < rows:
                    self._open[gap].append((row + used, rows - used))
                n -= self._fill(length, n, row, used, per_row, gap)
        if n:
            per_row = self.capacity // length
            rows = -(-n // per_row)
            self._fill(length, n, self._new_rows(rows), rows, per_row, self.capacity)

    def _fill(self, length: int, n: int, row: int, rows: int, per_row: int, gap: int) -> int:
        """Put up to ``per_row`` pieces into each row; the last row may get fewer."""
        placed = min(n, rows * per_row)
        self._put(length, placed, row, per_row, self.capacity - gap)
        full, rest = divmod(placed, per_row)
        if full:
            self._open[gap - per_row * length].append((row, full))
        if rest:
            self._open[gap - rest * length].append((row + full, 1))
        return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to rows with ``doc_id, piece, start, length, ids_crc32``.

    Lengths lie between 1 and ``capacity``.
    """
    numbered = with_index(pieces, [F.col("length").asc(), F.col("doc_id").asc(), F.col("piece").asc(), F.col("ids_crc32").asc()], "__number")
    numbered = materialise(numbered, "pieces")
    # One row per length: at most ``capacity`` of them.
    counts = {row["length"]: row["n"] for row in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity)
    first, begins = {}, 0
    for length in sorted(counts):
        first[length] = begins
        begins += counts[length]
    entries = {length: np.array(runs, dtype=np.int64) for length, runs in plan.entries.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            numbers = batch.column("__number").to_numpy(zero_copy_only=False)
            rows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                here = lengths == length
                rank, runs = numbers[here] - first[length], entries[length]
                run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
                rows[here] = run[:, 1] + (rank - run[:, 0]) // run[:, 2]
                offsets[here] = run[:, 3] + (rank - run[:, 0]) % run[:, 2] * length
            yield {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": rows, "offset": offsets}

    return map_batches(numbered, work, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the row and the place they are packed at."""
    # Written before the sort, which reads its input twice to find its ranges.
    return pack(materialise(token_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
