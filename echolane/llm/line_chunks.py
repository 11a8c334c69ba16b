"""Repeated passages, by content-defined chunks of lines.

Texts are cut into pieces: lines, inside them sentences and clauses, each with the marks that end
it, and inside those runs of words, which end after longer words with certain last letters. A rolling
hash over the hashes of two neighbouring pieces decides where a chunk begins: where it is lower than
both beside it. So boundaries depend on what stands there and move with it, a chunk has two pieces or
more, three on average, and a passage of fifty words hardly ever lacks a whole one, however it is
punctuated. Chunks that occur more than once anywhere are compared by their bytes with the first
occurrence; all others that equal it go. A passage begins and ends inside chunks that it shares with
its surroundings, so a removed chunk also takes those pieces before and after it that stand in the
same order beside the first occurrence.

Only hashes of chunks meet in a shuffle; the bytes of those that repeat follow, once. Hot chunks are
counted before the shuffle, and what joins them to their first occurrence are plain joins, whose
skewed keys Spark splits.

Defined cases: a missing text is an empty one and stays as it is where nothing is removed; of
equal rows none is taken for a copy of the other, they get equal rows; of equal chunks the one in
the document with the smallest id is the first (missing ids come last), then the one with the
smallest place; other bytes under the hash of a first chunk stay; words that no letter rule parts
are one piece, which alone is no chunk; a text of which all goes is empty. Extra columns are kept by ``drop_repeats`` and
may have any names but those that begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


# Every second letter or digit, beyond Latin every second block of 32 characters. The many blocks are
# looked through only for characters beyond Latin.
HALF = "".join(chr(c) for c in (*range(0x30, 0x3A, 2), *range(0x42, 0x5B, 2), *range(0x62, 0x7B, 2), *range(0xC0, 0x100, 2)))
HALF += r"[[^\x00-\xff]&&[%s\x{ac00}-\x{c1ff}]]" % "".join(f"\\x{{{a:x}}}-\\x{{{a + 31:x}}}" for a in range(0x100, 0x1000, 64))

# Where pieces end: after a line break, after a mark and a space, and after a word of five characters or
# more whose last one is of that half. A sign that texts hardly ever hold marks these places, which is
# faster than a pattern without width; a text that holds the sign is cut by such a pattern instead.
AFTER = r"(?:(?<=\n)|(?<=[.!?,;:]\x20)|(?<=%s[%s]\x20)(?!\x20))(?!\z)" % (r"[^\x20\n]" * 4, HALF)
SIGN = "\x01"

# What parts pieces inside a chunk, and chunks: trimmed pieces hold no line break and end without a space.
INSIDE, BETWEEN = "\n", " \n"

# Least characters of a chunk that may go, which has two pieces or more; pieces beside a chunk that may
# go with it, more than the few in a row whose chunks are too short or end elsewhere.
MIN_CHARS, BESIDE = 40, 12

_LAST = (1 << 63) - 1
_KEYS = ["__id", "__place"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "__place": F.xxhash64(text)})


def pieces(text: Column) -> Column:
    """Put together, they are the text."""
    marked = F.split(F.regexp_replace(text, r"[\x20\n]" + AFTER, "$0" + SIGN), SIGN, -1)
    cut = F.when(F.contains(text, F.lit(SIGN)), F.split(text, r"(?<=[\x20\n])" + AFTER, -1)).otherwise(marked)
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def trimmed_pieces(text: Column) -> Column:
    """Without what parts them from the next one, so that the end of a line is like one inside it.

    The cut takes one character. Marks and words stand right before it, so there is more to trim only
    where it is a line break after a space, and at the end of the text.
    """
    cut = F.split(text, r"[\x20\n]" + AFTER, -1)
    more = F.endswith(text, F.lit(" ")) | F.endswith(text, F.lit("\n")) | F.contains(text, F.lit(" \n"))
    trimmed = F.when(more, F.transform(cut, lambda p: F.rtrim(p, F.lit(" \n")))).otherwise(cut)
    return F.when(F.length(text) > 0, trimmed).otherwise(F.array().cast("array<string>"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once, however often it is used: nothing is merged across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _pairs() -> Column:
    """Rolling hashes of two neighbours: at each piece but the first that of it and the one before; highest at both ends."""
    most = F.array(F.lit(_LAST))
    others = F.slice("__pieces", F.lit(2), F.greatest(F.size("__pieces") - 1, F.lit(0)))
    pairs = F.transform(others, lambda p, i: F.xxhash64(F.xxhash64(F.get("__pieces", i)), F.xxhash64(p)))
    return F.concat(most, pairs, most)


# Whether a chunk begins after piece ``i``: at the second piece of a pair below its neighbours.
_ENDS = "get(__pairs, i + 1) < get(__pairs, i) and get(__pairs, i + 1) <= get(__pairs, i + 2)"


def _starts() -> Column:
    """Places where chunks begin, and the number of pieces."""
    ends = F.expr(f"filter(transform(__pieces, (p, i) -> if({_ENDS}, i + 1, null)), i -> i is not null)")
    return F.concat(F.array(F.lit(0)), ends, F.array(F.size("__pieces")))


def _bytes() -> Column:
    """The bytes of all chunks. A slice for each chunk would go through all pieces every time."""
    marked = F.expr(f"transform(__pieces, (p, i) -> if({_ENDS}, concat(p, ' '), p))")
    return F.split(F.array_join(marked, INSIDE), BETWEEN, -1)


def _chunked(keyed: DataFrame, *more: str) -> DataFrame:
    """Adds ``__pieces`` trimmed and their ``__pairs``."""
    rows = _once(keyed, "__pieces", trimmed_pieces(F.col("text"))).select(*_KEYS, *more, "__pieces")
    return _once(rows, "__pairs", _pairs())


def _chunks(rows: DataFrame) -> DataFrame:
    """``__id, __place, no, hash`` of chunks of several pieces and enough characters."""
    chunks = rows.select(*_KEYS, F.posexplode(_bytes()).alias("no", "bytes"))
    several = F.contains("bytes", F.lit(INSIDE)) & (F.length("bytes") >= MIN_CHARS)
    return chunks.where(several).select(*_KEYS, "no", F.xxhash64("bytes").alias("hash"))


def _repeated(chunks: DataFrame) -> DataFrame:
    """``__id, __place, spans``: the chunks of each document whose hash occurs more than once, and whether as the first."""
    order = F.struct(*_KEYS, "no")
    often = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    spans = chunks.join(often, "hash").select(*_KEYS, F.struct("no", "hash", (order == F.col("first")).alias("first")).alias("span"))
    return spans.groupBy(*_KEYS).agg(F.collect_set("span").alias("spans"))


def _candidates(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """Repeated chunks with their bytes and the hashes of ``BESIDE`` pieces on both sides."""
    place = lambda c: (F.get("__starts", c["no"]).alias("at"), F.get("__starts", c["no"] + 1).alias("end"))
    found = F.transform("spans", lambda c: F.struct(*place(c), c["hash"].alias("hash"), c["first"].alias("first"), F.get("__bytes", c["no"]).alias("bytes")))
    rows = _chunked(keyed.join(spans, _KEYS), "spans")
    hashes = F.transform("__pieces", lambda p: F.xxhash64(p))
    rows = rows.select(*_KEYS, "spans", hashes.alias("__hashes"), _starts().alias("__starts"), _bytes().alias("__bytes"))
    rows = _once(rows, "__found", found).select(*_KEYS, "__hashes", F.explode("__found").alias("c"))
    at, end = F.col("c.at"), F.col("c.end")
    before, after = F.greatest(at - BESIDE, F.lit(0)), F.least(end + BESIDE, F.size("__hashes"))
    return rows.select(
        *_KEYS,
        "c.*",
        F.reverse(F.slice("__hashes", before + 1, at - before)).alias("before"),
        F.slice("__hashes", end + 1, after - end).alias("after"),
    )


def _same_from_start(left: str, right: str) -> Column:
    first = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first > 0, first - 1).otherwise(F.size(left)).cast("int")


def removed_pieces(docs: DataFrame) -> DataFrame:
    """``__id, __place, __gone``: the numbers of the pieces that repeat what stands earlier."""
    return _gone(_keyed(docs))


def _gone(keyed: DataFrame) -> DataFrame:
    chunks = materialise(_chunks(_chunked(keyed)), "chunks")
    # Written, so that the shuffles of chunks are gone before texts are shuffled.
    spans = materialise(_repeated(chunks), "spans")
    discard(chunks)
    rows = materialise(_candidates(keyed, spans), "candidates")
    discard(spans)
    # Equal rows give the same first chunk more than once.
    beside = [F.col(c).alias(f"first_{c}") for c in ("bytes", "before", "after")]
    first = rows.where("first").groupBy("hash").agg(F.any_value(F.struct(*beside)).alias("f")).select("hash", "f.*")
    copies = rows.where("not first").join(first, "hash").where(F.col("bytes") == F.col("first_bytes"))
    begin = F.col("at") - _same_from_start("before", "first_before")
    end = F.col("end") + _same_from_start("after", "first_after")
    numbers = copies.select(*_KEYS, F.sequence(begin, end - 1).alias("numbers"))
    gone = numbers.groupBy(*_KEYS).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("__gone"))
    gone = materialise(gone, "gone")
    discard(rows)
    return gone


def _cleaned(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs)
    rows = keyed.join(_gone(keyed), _KEYS, "left")
    every = F.sequence(F.lit(0), F.size("__all") - 1)
    kept = F.array_join(F.transform(F.array_except(every, "__gone"), lambda i: F.get("__all", i)), "")
    rows = _once(rows, "__all", F.when(F.col("__gone").isNotNull(), pieces(F.col("text"))))
    return rows.withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages taken out of ``text``; all rows and columns stay."""
    return _cleaned(docs).select(*(F.col("__text").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, removed_chars, text`` for every document."""
    rows = _cleaned(docs.select("doc_id", "text"))
    lost = F.length(F.coalesce("text", F.lit(""))) - F.length(F.coalesce("__text", F.lit("")))
    return rows.select("doc_id", F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), lost.cast("long").alias("removed_chars"), F.coalesce("__text", F.lit("")).alias("text"))
