"""How two tokenizers cut the same texts, and how often their tokens end together.

Each distinct text is tokenised once: texts are shuffled whole and counted, and what is measured on
one is joined to all documents that hold it. A text's tokens A come from a byte-level BPE file
applied to a space and the text, tokens B from a sentence-piece model, which adds the space itself.
Byte offsets at which tokens of both end cut them into groups, and the two tokens that end there are
linked. How often an id pair is linked in the corpus is the number of its links in distinct texts,
each weighed by the number of documents with that text.

Pair counts are summed inside tasks before they are shuffled. The most frequent pairs, at most
``HEAD`` of them, travel back to the texts in arrays; links of rarer pairs are joined by pair, where no
key is hot any more. The best count of a B id is a table of at most one row per id of the vocabulary.
Texts of more than one in ``HOT`` documents, fewer than ``HOT`` in number, are joined by broadcast,
the others by the SHA-256 of the text.

Defined cases: a missing or empty text, and one whose tokens don't give back its bytes (the
sentence-piece model normalises some characters), has no tokens and zeros everywhere; rows without
an id and equal rows are answered each; strings of special tokens are plain text; a text of any
length is one row of its task; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, worker_store
from .tokens import ByteLevel

# Pairs whose counts travel to the texts (24 bytes each); texts above one in so many rows are hot;
# texts tokenised at a time; pairs that a task sums up before it hands them on.
HEAD, HOT, TEXTS, HELD_PAIRS = 500_000, 1_000, 200, 2_000_000

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"

class Pieces:
    """Token ids and token bytes of a sentence-piece model."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.bytes_of = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers, with tables of their tokens' lengths and of what the group text holds for them."""

    def __init__(self, vocabulary: str, model: bytes):
        self.a, self.b = ByteLevel(vocabulary, marks_as_text=True), Pieces(model)
        self.lengths = [np.array([len(t) for t in side.bytes_of], np.int64) for side in (self.a, self.b)]
        self.n_a, self.n_b = len(self.a.bytes_of), len(self.b.bytes_of)
        # Ids of A inside and at the end of a group, then ids of B.
        ends = [(self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";")]
        self.shown = [f"{i}{mark}" for n, mark in ends for i in range(n)]

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; none where a side does not give back the bytes."""
        spaced = [" " + t for t in texts]
        for text, a, b in zip(spaced, self.a.encode(spaced), self.b.encode(texts)):
            data = text.encode("utf-8", "surrogatepass")
            same = all(b"".join(map(side.bytes_of.__getitem__, ids)) == data for side, ids in ((self.a, a), (self.b, b)))
            yield (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """Places of the last tokens of both sides in every group, and the groups as text."""
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        marks = np.zeros(int(ends_a[-1]) + 1, np.int8)
        marks[ends_a] = 1
        last_b = marks[ends_b].astype(bool)
        marks[ends_b] += 1
        last_a = marks[ends_a] == 2
        stop_a, stop_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        # Before a token of A stand the tokens of B of earlier groups; before one of B those of A up to its own group.
        before_a = np.concatenate([[0], stop_b + 1])[np.cumsum(last_a) - last_a]
        before_b = (stop_a + 1)[np.cumsum(last_b) - last_b]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before_a] = a + self.n_a * last_a
        codes[np.arange(len(b)) + before_b] = b + 2 * self.n_a + self.n_b * last_b
        return stop_a, stop_b, "".join(map(self.shown.__getitem__, codes.tolist()))[:-1]


def _aligner(vocabulary: str, model: bytes) -> Aligner:
    store = worker_store("aligners")
    key = hashlib.sha256(vocabulary.encode() + model).digest()
    if key not in store:
        store[key] = Aligner(vocabulary, model)
    return store[key]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def align_texts(docs: DataFrame, vocabulary: str, model: bytes) -> DataFrame:
    """Every distinct text that has tokens: its key, its copies, its groups and its links.

    A link is the number ``a * ids of B + b``, eight bytes in ``links``.
    """
    texts = _keyed(docs).where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select("text", "copies", F.unhex(F.sha2("text", 256)).alias("key"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        aligner = _aligner(vocabulary, model)
        names = [field.rsplit(" ", 1)[0] for field in ALIGNED.split(", ")]
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                out: dict[str, list] = {name: [] for name in names}
                columns = [part.column(c).to_pylist() for c in ("key", "copies")]
                for key, copies, tokens in zip(*columns, aligner.tokens(part.column("text").to_pylist())):
                    if tokens is None:
                        continue
                    stop_a, stop_b, groups = aligner.align(*tokens)
                    links = (tokens[0][stop_a] * aligner.n_b + tokens[1][stop_b]).astype("<i8").tobytes()
                    n = len(stop_a)
                    row = (key, copies, len(tokens[0]), len(tokens[1]), n, n, hashlib.sha256(groups.encode()).hexdigest(), links)
                    for name, value in zip(names, row):
                        out[name].append(value)
                yield out

    return map_batches(texts, work, ALIGNED)


def _links(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(column)]


def pair_counts(aligned: DataFrame, ids_of_b: int) -> DataFrame:
    """``pair, n, best`` of every id pair: its links in all documents, and whether no pair of its B id has more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # Sums stay in a few sorted runs, merged as they double, so that a pair is moved a few times at most.
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            copies, links = batch.column("copies").to_numpy(), _links(batch, "links")
            for begin in range(0, len(links), TEXTS):
                part = links[begin : begin + TEXTS]
                run = _summed(np.concatenate(part), np.repeat(copies[begin : begin + TEXTS], [len(x) for x in part]))
                while runs and len(runs[-1][0]) <= 2 * len(run[0]):
                    run = _summed(*map(np.concatenate, zip(runs.pop(), run)))
                runs.append(run)
                if sum(len(r[0]) for r in runs) > HELD_PAIRS:
                    yield from ({"pair": p, "n": n} for p, n in runs)
                    runs = []
        yield from ({"pair": p, "n": n} for p, n in runs)

    counts = map_batches(aligned.select("copies", "links"), work, "pair long, n long")
    counts = materialise(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.pmod("pair", F.lit(ids_of_b)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, weights = pairs[order], weights[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def _head_count(pairs: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` pairs have it or more, read off a histogram of a few hundred steps."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    rows = sorted(pairs.groupBy(step).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("pairs")).collect(), reverse=True)
    least, room = None, head
    for row in rows:
        room -= row["pairs"]
        if room < 0:
            break
        least = row["least"]
    return least if least is not None else (rows[0]["least"] + (1 << 62) if rows else 0)


def measure_links(aligned: DataFrame, pairs: DataFrame, head: int = HEAD) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to aligned texts, without their links."""
    least = _head_count(pairs, head)
    top = pairs.where(F.col("n") >= least).toPandas().sort_values("pair")  # at most ``head`` rows
    known, counts, best = (top[c].to_numpy() for c in ("pair", "n", "best"))
    schema = ALIGNED.replace("links binary", "n_best long, count_sum long, rest array<long>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sums, bests, rest = [], [], []
            for links in _links(batch, "links"):
                at = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0))
                hit = known[at] == links if len(known) else np.zeros(len(links), bool)
                sums.append(int(counts[at[hit]].sum()))
                bests.append(int(best[at[hit]].sum()))
                rest.append(links[~hit])
            kept = {name: batch.column(name) for name in batch.schema.names if name != "links"}
            yield kept | {"n_best": bests, "count_sum": sums, "rest": rest}

    found = materialise(map_batches(aligned, work, schema), "measured")
    rare = found.select("key", F.explode("rest").alias("pair")).groupBy("key", "pair").agg(F.count(F.lit(1)).alias("times"))
    rare = rare.join(pairs.where(F.col("n") < least), "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("n") * F.col("times")).alias("rare_sum")
    )
    whole = found.drop("rest").join(rare, "key", "left")
    for name, more in (("n_best", "rare_best"), ("count_sum", "rare_sum")):
        whole = whole.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0))).drop(more)
    return whole


def to_documents(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """Every document with the measures of its text."""
    ids = _keyed(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    measured = materialise(measured, "texts")
    rows = measured.agg(F.sum("copies")).first()[0] or 0
    hot = measured.where(F.col("copies") * HOT > rows)  # fewer than HOT rows
    by_key = ids.join(F.broadcast(hot), "key")
    others = ids.join(F.broadcast(hot.select("key")), "key", "left_anti")
    whole = by_key.unionByName(others.join(measured.where(F.col("copies") * HOT <= rows), "key", "left"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*MEASURES, "n_best", "count_sum"]]
    return whole.select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def align_documents(docs: DataFrame, vocabulary: str, model: bytes, head: int = HEAD) -> DataFrame:
    """Per document: numbers of tokens, groups, links and best links, the sum of the links' counts, and the groups' digest."""
    from sentencepiece import SentencePieceProcessor

    ids_of_b = SentencePieceProcessor(model_proto=model).get_piece_size()
    aligned = materialise(align_texts(docs, vocabulary, model), "aligned")
    pairs = materialise(pair_counts(aligned, ids_of_b), "counts")
    return to_documents(docs, measure_links(aligned, pairs, head))


def load_model(path: str) -> bytes:
    """The sentence-piece model's bytes, half a MB, which travel with the job."""
    return Path(path).read_bytes()
