"""Comment corpus: cleaning, vocabulary, context pairs, padded sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from ..session import materialise
from .order import with_index

# A vocabulary lookup broadcasts at most this many words; the rest is joined by shuffle.
HEAD_WORDS = 500_000

# Pairs that a task adds up at a time, rows that it hands on at a time.
_MET_PAIRS, _MET_ROWS = 2_000_000, 100_000

# An id stands in so many bits below its place in the sentence.
_ID_BITS = 33

# Longest sequence, shortest sequence, filler id.
MAX_LENGTH, MIN_LENGTH, PAD = 21, 3, 0

APOSTROPHES = {"keep": [], "lone": ["'"], "lone_or_double": ["'", "''"]}


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of a text column: ``key, line_no, line``."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def drop_noise(df: DataFrame, line: str = "line") -> DataFrame:
    return df.where(~T.is_noise(F.col(line)))


def tokenize(
    df: DataFrame, line: str = "line", profile: str = "full", apostrophes: str | None = None
) -> DataFrame:
    """Clean every line into ``tokens``; lines of fewer than two words vanish.

    Profile ``full`` also drops noise lines and digit runs; ``tags`` strips markup instead.
    The length is tested before the apostrophe is removed.
    """
    if profile == "full":
        df, words = drop_noise(df, line), T.words_full(F.col(line))
        marks = APOSTROPHES[apostrophes or "lone_or_double"]
    elif profile == "tags":
        words = T.words_tagged(F.col(line))
        marks = APOSTROPHES[apostrophes or "keep"]
    else:
        raise ValueError(f"unknown profile {profile!r}")
    # Wrapped in an array, so that the cleaning runs once and not again for the length test.
    kept = F.filter(F.array(words), lambda w: F.size(w) > 1)
    if marks:
        kept = F.transform(kept, lambda w: T.drop_first_of(w, marks))
    others = [c for c in df.columns if c != line]
    return df.select(*others, F.explode(kept).alias("tokens"))


def word_freq(sentences: DataFrame, tokens: str = "tokens") -> DataFrame:
    words = sentences.select(F.explode(tokens).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def build_vocab(
    freq: DataFrame,
    min_count: int = 0,
    specials: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    drop_top: bool = False,
) -> DataFrame:
    """Words seen more than ``min_count`` times, numbered from 1 by falling frequency.

    Equal frequencies are ordered by word. ``specials`` get the next free numbers in order
    and no frequency. ``drop_top`` leaves out the most frequent word and keeps the numbers.
    """
    kept = freq.where(F.col("freq") > min_count).where(~F.col("word").isin(*exclude))
    vocab = with_index(kept, [F.col("freq").desc(), F.col("word").asc()], "id", start=1)
    vocab = vocab.select("word", "id", "freq")
    if specials:
        size = vocab.count()
        marks = [(word, size + 1 + i, None) for i, word in enumerate(specials)]
        vocab = vocab.unionByName(freq.sparkSession.createDataFrame(marks, vocab.schema))
    return vocab.where("id > 1") if drop_top else vocab


def lookup(df: DataFrame, vocab: DataFrame, word: str, name: str, how: str = "inner") -> DataFrame:
    """Replace the column ``word`` by its id ``name``; unknown words go or become null."""
    table = vocab.select(F.col("word").alias(word), F.col("id").alias(name), in_head(vocab))
    return match(df, table, word, how).drop(word)


def spell(df: DataFrame, vocab: DataFrame, id_column: str, name: str) -> DataFrame:
    """Replace an id by its word ``name``; ids without a word go."""
    table = vocab.select(F.col("id").alias(id_column), F.col("word").alias(name), in_head(vocab))
    return match(df, table, id_column, "inner").drop(id_column)


def in_head(vocab: DataFrame) -> Column:
    """Frequent words by their rank, and the marks, which have no frequency and the last ids."""
    marks = F.col("freq").isNull() if "freq" in vocab.columns else F.lit(False)
    return ((F.col("id") <= HEAD_WORDS) | marks).alias("__head")


def match(df: DataFrame, table: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join rows with the entry of their word in a table with a column ``__head``.

    The most frequent words, which could overload single shuffle partitions, are matched by a
    broadcast of fixed size. Only the rare rest of a larger vocabulary is joined by shuffle.
    """
    head, tail = table.where("__head").drop("__head"), table.where("NOT __head").drop("__head")
    if tail.isEmpty():
        return df.join(F.broadcast(head), on, how)
    common = df.join(F.broadcast(head), on, "inner")
    rare = df.join(F.broadcast(head.select(*([on] if isinstance(on, str) else on))), on, "left_anti").join(tail, on, how)
    return common.unionByName(rare)


def forward_pairs(sentences: DataFrame, window: int, tokens: str = "tokens") -> DataFrame:
    """Each word with the words up to ``window`` places after it, as ``left, right``."""
    others = [c for c in sentences.columns if c != tokens]
    return sentences.select(*others, F.explode(_ahead(window, tokens)).alias("pair")).select(
        *others, F.col("pair.left").alias("left"), F.col("pair.right").alias("right")
    )


def _ahead(window: int, tokens: str) -> Column:
    words, size = F.col(tokens), F.size(tokens)
    return F.concat(*[_shifted(words, size, gap) for gap in range(1, window + 1)])


def pair_figures(sentences: DataFrame, window: int, tokens: str = "tokens") -> DataFrame:
    """The ``context_pairs`` of each sentence as figures: ``pairs, repeats, first_center, last_context``.

    They are added up inside the sentence, so that no pair becomes a row: least and greatest words
    of rows would be found by a sort of all pairs. Sentences without a pair go.
    """
    others = [c for c in sentences.columns if c != tokens]
    rows = sentences.where(F.size(tokens) > 1).select(*others, _ahead(window, tokens).alias("__pairs"))
    # Both words of a pair are center and context, once each.
    words = F.concat("__pairs.left", "__pairs.right")
    return rows.select(
        *others,
        (2 * F.size("__pairs")).cast("long").alias("pairs"),
        (2 * F.size(F.filter("__pairs", lambda p: p["left"] == p["right"]))).cast("long").alias("repeats"),
        F.array_min(words).alias("first_center"),
        F.array_max(words).alias("last_context"),
    )


def _shifted(words: Column, size: Column, gap: int) -> Column:
    count = F.greatest(size - gap, F.lit(0))
    start = F.least(F.lit(gap + 1), size)
    zipped = F.arrays_zip(
        F.slice(words, 1, count).alias("left"), F.slice(words, start, count).alias("right")
    )
    return zipped


def context_pairs(sentences: DataFrame, window: int, tokens: str = "tokens") -> DataFrame:
    """Each word (``center``) with every neighbour (``context``) up to ``window`` places away."""
    both = F.array(
        F.struct(F.col("left").alias("center"), F.col("right").alias("context")),
        F.struct(F.col("right").alias("center"), F.col("left").alias("context")),
    )
    pairs = forward_pairs(sentences, window, tokens)
    others = [c for c in sentences.columns if c != tokens]
    return pairs.select(*others, F.inline(both))


def pair_counts(sentences: DataFrame, window: int, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """How often two known words are neighbours: ``center, context, n`` with vocabulary ids.

    Distances count unknown words as well. Words become ids before the first shuffle, by the head of
    the vocabulary, so pairs with unknown words go early and the others are two numbers, smaller one
    first. Where the head is the whole vocabulary, a task adds pairs up before they become rows. The
    other direction is mirrored without a shuffle. Words beyond the head are looked up in what has
    been added up.
    """
    marked = vocab.select("word", "id", in_head(vocab))
    tail = marked.where("NOT __head").select("word", "id")
    if tail.isEmpty():
        head = sentences.sparkSession.sparkContext.broadcast(marked.select("word", "id").orderBy("id").toArrow())
        known = sentences.select(tokens).mapInArrow(_meeting(head, window), "a long, b long, n long")
    else:
        known = _with_tail(forward_pairs(sentences.select(tokens), window, tokens), vocab.where(in_head(vocab)), tail)
    counts = known.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))
    # A pair of equal words is its own mirror image and counts twice.
    once = F.array(F.struct(F.col("a").alias("center"), F.col("b").alias("context"), (F.col("n") * 2).alias("n")))
    both = F.array(
        F.struct(F.col("a").alias("center"), F.col("b").alias("context"), "n"),
        F.struct(F.col("b").alias("center"), F.col("a").alias("context"), "n"),
    )
    return counts.select(F.inline(F.when(F.col("a") == F.col("b"), once).otherwise(both)))


def _meeting(head: Broadcast, window: int) -> Callable:
    """Sentences as their pairs of known words: ids in order and how often they meet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = head.value["word"].combine_chunks(), head.value["id"].to_numpy()
        waiting, size = [], 0

        def added_up() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(waiting), return_counts=True)
            for at in range(0, len(pairs), _MET_ROWS):
                a, b = np.divmod(pairs[at : at + _MET_ROWS], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], n[at : at + _MET_ROWS])], ["a", "b", "n"])

        for batch in batches:
            lists = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=words, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for gap in range(1, window + 1):
                first = np.flatnonzero(row[gap:] == row[:-gap])
                x, y = found[first], found[first + gap]
                both = (x >= 0) & (y >= 0)
                waiting.append(np.minimum(x, y)[both] * len(ids) + np.maximum(x, y)[both])
                size += len(waiting[-1])
            if size > _MET_PAIRS:
                yield from added_up()
                waiting, size = [], 0
        if size:
            yield from added_up()

    return work


def _with_tail(pairs: DataFrame, head: DataFrame, tail: DataFrame) -> DataFrame:
    """Known pairs ``a, b, n`` of words ``left, right``, which are formed once.

    They are added up with the ids of frequent words and the names of others; these pairs, far
    fewer, are written, and the names are looked up in them.
    """

    def ids(table: DataFrame, word: str, name: str) -> DataFrame:
        return table.select(F.col("word").alias(word), F.col("id").alias(name))

    met = pairs.join(F.broadcast(ids(head, "left", "a")), "left", "left").join(F.broadcast(ids(head, "right", "b")), "right", "left")
    met = met.where("(a IS NOT NULL OR left IS NOT NULL) AND (b IS NOT NULL OR right IS NOT NULL)")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    met = met.groupBy(
        F.when(both, F.least("a", "b")).otherwise(F.col("a")).alias("a"),
        F.when(both, F.greatest("a", "b")).otherwise(F.col("b")).alias("b"),
        F.when(F.col("a").isNull(), F.col("left")).alias("left"),
        F.when(F.col("b").isNull(), F.col("right")).alias("right"),
    )
    met = materialise(met.agg(F.count(F.lit(1)).alias("n")), "pairs")
    columns = ["a", "b", "right", "n"]
    found = met.where("left IS NOT NULL").drop("a").join(ids(tail, "left", "a"), "left").select(columns)
    found = found.unionByName(met.where("left IS NULL").select(columns))
    named = found.where("right IS NOT NULL").drop("b").join(ids(tail, "right", "b"), "right")
    return found.where("right IS NULL").select("a", "b", "n").unionByName(named.select("a", "b", "n"))


def encode(
    sentences: DataFrame, key: list[str], vocab: DataFrame, first: int | None = None, tokens: str = "tokens"
) -> DataFrame:
    """Ids of the known words of each sentence, in order: ``key…, ids``.

    Frequent words are looked up inside the sentence, so that no word becomes a row and a sentence
    stays where it is. Only words beyond the head travel, to the rare words of the vocabulary and back
    to their sentence, and rows whose key comes more than once, which are merged: place and id of a
    word are one number, which puts them in order. Where only the ``first`` known words are
    wanted, the others are cut before the shuffle.
    """
    marked = vocab.select("word", "id", in_head(vocab))
    tail = marked.where("NOT __head").select(F.col("word").alias("__word"), F.col("id").alias("__id"))
    head = sentences.sparkSession.sparkContext.broadcast(marked.where("__head").select("word", "id").toArrow())
    words = sentences.select(*key, F.col(tokens).alias("__tokens"))
    rest = K.ArrayType(K.StructType().add("at", K.IntegerType()).add("word", K.StringType()))
    schema = K.StructType([words.schema[c] for c in key]).add("__known", K.ArrayType(K.LongType())).add("__rest", rest)
    whole = tail.isEmpty()
    known = words.mapInArrow(_coder(head, first, not whole), schema)
    if not whole:
        known = materialise(known, "coded")
    repeated = sentences.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    repeated = materialise(repeated.select(*[F.col(c).alias(f"__{c}") for c in key]), "repeated")
    complete = F.size("__rest") == 0
    parts = []
    if not repeated.isEmpty():
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
        parts.append(known.join(repeated, same, "left_semi"))
        known = known.join(repeated, same, "left_anti")
    alone = known.where(complete).select(*key, F.col("__known").alias("ids"))
    if not whole:
        parts.append(known.where(~complete))
    if parts:
        apart = reduce(DataFrame.unionByName, parts)
        rare = apart.select(*key, F.inline("__rest").alias("__at", "__word")).join(tail, "__word")
        placed = F.shiftleft(F.col("__at").cast("long"), _ID_BITS).bitwiseOR(F.col("__id"))
        apart = apart.select(*key, "__known").unionByName(rare.select(*key, F.array(placed).alias("__known")))
        merged = apart.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("__known"))).alias("ids"))
        alone = alone.unionByName(merged if first is None else merged.withColumn("ids", F.slice("ids", 1, first)))
    return alone.where(F.size("ids") > 0).withColumn("ids", F.transform("ids", lambda x: x.bitwiseAND((1 << _ID_BITS) - 1)))


def _coder(head: Broadcast, first: int | None, with_rest: bool) -> Callable:
    """Batches of ``key…, __tokens`` with the places and ids of frequent words, and the other words if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = head.value["word"].combine_chunks(), head.value["id"].to_numpy()
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            found = pc.fill_null(pc.index_in(flat, value_set=words, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
            known = found >= 0
            wanted = np.ones(len(row), bool)
            if first is not None:
                before = np.cumsum(known) - known
                wanted = before - before[np.searchsorted(row, row)] < first
            mine = known & wanted
            columns = [*batch.columns[:-1], _lists(row[mine], len(sizes), pa.array((at[mine] << _ID_BITS) | ids[found[mine]]))]
            others = ~known & wanted & with_rest
            rest = pa.StructArray.from_arrays([pa.array(at[others].astype(np.int32)), flat.filter(pa.array(others))], ["at", "word"])
            columns.append(_lists(row[others], len(sizes), rest))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "__known", "__rest"])

    return work


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """One list per row of the values that name it, which stand in order."""
    ends = np.cumsum(np.bincount(row, minlength=rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def sentence_text(sequences: DataFrame, key: list[str], vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """The words of each sequence, joined by blanks: ``key…, sentence``."""
    places = sequences.select(*key, F.posexplode(ids).alias("__pos", "__id"))
    words = spell(places, vocab, "__id", "__word")
    packed = words.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__pos", "__word"))).alias("__packed"))
    return packed.select(*key, F.array_join("__packed.__word", " ").alias("sentence"))


def end_sequences(
    encoded: DataFrame, end_id: int, max_length: int = MAX_LENGTH, min_length: int = MIN_LENGTH
) -> DataFrame:
    """Add the end mark, drop short sequences, cut long ones (which lose the mark)."""
    whole = F.concat("ids", F.array(F.lit(end_id).cast("long")))
    return encoded.where(F.size("ids") + 1 >= min_length).withColumn("ids", F.slice(whole, 1, max_length))


def whole_sentences(
    sentences: DataFrame, key: list[str], vocab: DataFrame, end_mark: str = T.END_MARK
) -> DataFrame:
    """Ids of all known words of each sentence and the end mark, uncut: ``key…, ids``."""
    end_id = vocab.where(F.col("word") == end_mark).first()["id"]
    encoded = encode(sentences, key, vocab.where(F.col("word") != end_mark))
    return encoded.withColumn("ids", F.concat("ids", F.array(F.lit(end_id).cast("long"))))


def longest(sequences: DataFrame, ids: str = "ids") -> int:
    return sequences.agg(F.max(F.size(ids))).first()[0] or 0


def pad(sequences: DataFrame, length: int, ids: str = "ids") -> DataFrame:
    filler = F.array_repeat(F.lit(PAD).cast("long"), length - F.size(ids))
    return sequences.withColumn(ids, F.concat(ids, filler))


def encode_sequences(
    sentences: DataFrame,
    key: list[str],
    vocab: DataFrame,
    end_mark: str = T.END_MARK,
    max_length: int = MAX_LENGTH,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """Sequences of word ids, ended, cut, and padded to the longest one."""
    end_id = vocab.where(F.col("word") == end_mark).first()["id"]
    words = vocab.where(F.col("word") != end_mark)
    ended = end_sequences(encode(sentences, key, words, max_length), end_id, max_length, min_length)
    saved = materialise(ended, "sequences")
    return pad(saved, longest(saved))


def shift_target(ids: Column) -> Column:
    """The sequence one step ahead, closed by the filler."""
    return F.concat(F.slice(ids, 2, F.size(ids)), F.array(F.lit(PAD).cast("long")))


def lm_examples(sequences: DataFrame, ids: str = "ids") -> DataFrame:
    return sequences.withColumn("targets", shift_target(F.col(ids)))


def prime_words(sequences: DataFrame, key: list[str], ids: str = "ids") -> DataFrame:
    return sequences.select(*key, F.element_at(ids, 1).alias("prime"))
