"""Search events: collection, catalogue search, impression labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import null_ids, singular_type
from ..session import materialise
from .comments import members
from .order import join_split, top_n, with_index

ID_COLUMNS = ["user_id", "song_id", "album_id", "playlist_id", "singer_id"]

# Length of a result page, results seen without a click, and the position after
# which a clicked song ends the list.
PAGE, SEEN, LAST_OPEN_POSITION = 100, 10, 10

# Heaviest words of a query whose sets give it its first answers, catalogue entries of one block,
# and blocks that a query looks into in its first round.
SET_WORDS, BLOCK, FIRST_BLOCKS = 6, 1_024, 4

# Scores are compared after rounding, so that ties are broken by id and not by noise.
DIGITS = 9


def collect_events(events: DataFrame, users: DataFrame, kind: str = "search") -> DataFrame:
    """Events of a type by listed users, missing ids as -1."""
    wanted = null_ids(events.where(F.col("type") == kind), ID_COLUMNS)
    return members(wanted, users, "user_id")


def sequence_id(df: DataFrame, *ties: str, name: str = "order") -> DataFrame:
    """Number events from 0, newest day first, then by time and the given columns.

    The ties have to tell events apart, as far as these are not the same in all columns.
    """
    return with_index(df, [F.col("dt").desc(), F.col("timestamp"), *map(F.col, ties)], name)


def keyword_search(queries: DataFrame, catalog: DataFrame, k: int = PAGE, block: int = BLOCK) -> DataFrame:
    """The ``k`` best catalogue entries of each distinct query: ``keyword, type, rank, id, score``.

    ``queries`` has ``keyword, type``; ``catalog`` has ``id, type, name``. An entry scores the
    sum of ln(1 + entries / entries with the word) over the words it shares with the query;
    equal scores are ordered by id.

    A hot word is shared by many queries and many entries, so queries and entries are never
    paired word by word. An entry in the answer shares some set of words with the query, and
    must be among the first ``k`` ids that hold this set, since all of them score at least as
    much. So each set of the six heaviest words of a query, and each of its other words alone, is
    answered once, whatever the number of queries, by its first ``k`` ids. That is all for queries
    of up to six words. A longer one takes the least score of its first answers as a threshold. An
    entry that is not among them shares only words with more than ``k`` entries.

    For those, entries lie in blocks of ``block`` neighbouring ids, and every word keeps the list of
    its blocks. A query takes its heavy words until the rest together cannot reach the threshold;
    the blocks of these words, each with the most that an entry in it can score, are looked into
    from the highest bound down, four times as many in every round, until no bound can beat what the
    query has found. That is exact whatever the number of words. Where no query is that long, entries
    are not put in order and have no blocks.
    """
    asked = materialise(queries.select("keyword", "type").distinct().withColumn("words", _distinct_words("keyword")), "asked")
    entries = catalog.select("id", "type", _distinct_words("name").alias("words"))
    if asked.where(F.size("words") > SET_WORDS).isEmpty():
        entries = entries.withColumn("block", F.lit(None).cast("long"))
    else:
        entries = with_index(entries, [F.col("type").asc(), F.col("id").asc()], "__at")
        entries = entries.withColumn("block", F.floor(F.col("__at") / block)).drop("__at")
    entries = materialise(entries, "entries")
    postings = entries.select("type", "id", "words", "block", F.explode("words").alias("word"))
    sizes = entries.groupBy("type").agg(F.count(F.lit(1)).alias("entries"))
    weights = postings.groupBy("type", "word").agg(F.count(F.lit(1)).alias("df")).join(sizes, "type")
    weights = weights.select("type", "word", "df", F.log1p(F.col("entries") / F.col("df")).alias("weight"))

    words = asked.select("keyword", "type", F.explode("words").alias("word"))
    known = words.join(weights, ["type", "word"]).groupBy("keyword", "type").agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("weight", "word", "df")))).alias("terms")
    )
    known = materialise(known, "queries")
    best = materialise(_best(_first_answers(known, postings, k), k), "best")
    best = _look_into_blocks(known.where(F.size("terms") > SET_WORDS), entries, postings, best, k)
    return best.select("keyword", "type", "rank", "id", "score")


def _distinct_words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def _score(terms: str, words: str) -> Column:
    shared = F.filter(terms, lambda t: F.array_contains(words, t["word"]))
    return F.aggregate(shared, F.lit(0.0), lambda acc, t: acc + t["weight"]).alias("score")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; an entry may have been found more than once."""
    once = scored.groupBy("keyword", "type", "id").agg(F.max("score").alias("score"))
    return top_n(once, ["keyword", "type"], [F.round("score", DIGITS).desc(), F.col("id").asc()], k)


def _first_answers(known: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    heaviest = F.slice("terms.word", 1, SET_WORDS)
    masks = F.sequence(F.lit(1), _bit(F.size(heaviest)) - 1)
    sets = known.select("keyword", "type", "terms", heaviest.alias("heaviest"), F.explode(masks).alias("mask")).select(
        "keyword", "type", "terms", F.filter("heaviest", lambda _, i: F.col("mask").bitwiseAND(_bit(i)) != 0).alias("set")
    )
    alone = known.where(F.size("terms") > SET_WORDS).select(
        "keyword", "type", "terms", F.explode(F.slice("terms.word", SET_WORDS + 1, F.size("terms"))).alias("word")
    )
    sets = sets.unionByName(alone.select("keyword", "type", "terms", F.array("word").alias("set")))
    sets = sets.select("keyword", "type", "terms", F.col("set")[0].alias("word"), F.array_sort("set").alias("set"))  # the rarest word
    wanted = sets.select("type", "word", "set").distinct()
    holding = postings.join(wanted, ["type", "word"]).where(F.forall("set", lambda w: F.array_contains("words", w)))
    lists = top_n(holding.select("type", "set", "id", "words"), ["type", "set"], [F.col("id").asc()], k).drop("rank")
    return sets.join(lists, ["type", "set"]).select("keyword", "type", "id", _score("terms", "words"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i)


def _thresholds(best: DataFrame, k: int) -> DataFrame:
    """Score and id of the last answer of each query that has ``k`` of them."""
    return best.where(F.col("rank") == k).select("keyword", "type", F.round("score", DIGITS).alias("least"), F.col("id").alias("last"))


def _bounded_blocks(known: DataFrame, postings: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Blocks that may hold a better entry: ``keyword, type, block, first, bound, turn``, the highest bound first."""
    # Entries of words with up to k of them are all among the answers.
    hot = known.join(_thresholds(best, k), ["keyword", "type"]).withColumn("hot", F.filter("terms", lambda t: t["df"] > k))
    after = lambda i: F.aggregate(F.slice("hot", i + 1, F.size("hot")), F.lit(0.0), lambda acc, t: acc + t["weight"])
    # Words from the heaviest on, as long as what is left can reach the threshold without those before.
    heavy = F.filter("hot", lambda t, i: F.round(after(i), DIGITS) >= F.col("least"))
    hot = hot.where(F.size("hot") > 1).withColumn("heavy", heavy).where(F.size("heavy") > 0)
    rest = F.aggregate(F.slice("hot", F.size("heavy") + 1, F.size("hot")), F.lit(0.0), lambda acc, t: acc + t["weight"])
    asking = hot.select("keyword", "type", "least", rest.alias("rest"), F.inline("heavy"))
    places = postings.join(asking.select("type", "word").distinct(), ["type", "word"]).groupBy("type", "word", "block").agg(F.min("id").alias("first"))
    bounds = asking.join(places, ["type", "word"]).groupBy("keyword", "type", "block", "least").agg(
        F.min("first").alias("first"), F.round(F.sum("weight") + F.max("rest"), DIGITS).alias("bound")
    )
    order = [F.col("bound").desc(), F.col("block").asc()]
    ranked = F.row_number().over(Window.partitionBy("keyword", "type").orderBy(*order))
    return bounds.where("bound >= least").drop("least").withColumn("turn", ranked)


def _look_into_blocks(known: DataFrame, entries: DataFrame, postings: DataFrame, best: DataFrame, k: int) -> DataFrame:
    if known.isEmpty():
        return best
    blocks = materialise(_bounded_blocks(known, postings, best, k), "bounds")
    done, turns = 0, FIRST_BLOCKS
    while True:
        # In the order of turns bounds fall, and ids rise where bounds are equal: past the first block that can't help none can.
        open_blocks = blocks.where((F.col("turn") > done) & (F.col("turn") <= done + turns)).join(_thresholds(best, k), ["keyword", "type"])
        open_blocks = open_blocks.where((F.col("bound") > F.col("least")) | (F.col("bound") == F.col("least")) & (F.col("first") <= F.col("last")))
        open_blocks = materialise(open_blocks.select("keyword", "type", "block", "least"), "looked")
        if open_blocks.isEmpty():
            return best
        met = open_blocks.join(known, ["keyword", "type"]).join(entries, ["type", "block"])
        found = met.select("keyword", "type", "id", "least", _score("terms", "words")).where(F.round("score", DIGITS) >= F.col("least"))
        best = materialise(_best(best.drop("rank").unionByName(found.drop("least")), k), "best")
        done, turns = done + turns, turns * 4


def result_lists(found: DataFrame) -> DataFrame:
    """Ranked rows as one array per query; a page has at most ``PAGE`` entries."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "id")))
    return found.groupBy("keyword", "type").agg(ranked.alias("r")).select(
        "keyword", "type", F.col("r.id").alias("results")
    )


def _windows(events: DataFrame, results: DataFrame, strict: bool) -> DataFrame:
    """Add the clicked entity, the examined part of the results and its first position.

    ``total`` counts the results the user could see, ``examined`` those up to the stop, and
    ``shown`` holds the results that become rows, the first one at position ``first``.
    """
    typed = events.withColumn("type", singular_type(F.col("type")))
    joined = join_split(typed, results, ["keyword", "type"])
    seen = (
        F.when(F.col("action") == "click", PAGE).when(F.col("action") == "show", SEEN).otherwise(0)
    )
    page = F.slice(F.coalesce("results", F.array().cast("array<long>")), 1, seen)
    is_song = F.col("type") == "song"
    clicked = (
        F.when(is_song, F.col("song"))
        .when(F.col("type") == "album", F.col("album"))
        .when(F.col("type") == "playlist", F.col("playlist"))
        .when(F.col("type") == "singer", F.col("singer"))
    )
    whole = joined.withColumn("page", page).withColumn("clicked", clicked).withColumn("total", F.size("page"))
    # A match before this place does not end the list.
    closed_from = F.when(is_song, 1 if strict else LAST_OPEN_POSITION + 1).otherwise(0)
    rest = F.slice("page", closed_from + 1, F.greatest(F.col("total") - closed_from, F.lit(0)))
    match = F.coalesce(F.array_position(rest, F.col("clicked")), F.lit(0)).cast("int")
    stop = F.when(match > 0, closed_from + match).otherwise(F.col("total"))
    top = F.get("page", F.lit(0))
    misdirected = is_song & ((top == F.col("singer")) | (top == F.col("album")))
    typed_kind = F.col("type").isin("song", "album", "playlist", "singer")
    examined = (
        F.when(~F.coalesce(typed_kind, F.lit(False)), 0)
        .when(F.coalesce(misdirected, F.lit(False)), F.least(F.col("total"), F.lit(1)))
        .otherwise(stop)
    )
    first = F.when(is_song, 1).otherwise(0)
    whole = whole.withColumn("examined", examined).withColumn("first", first)
    size = F.greatest(F.col("examined") - F.col("first"), F.lit(0))
    return whole.withColumn("shown", F.slice("page", F.col("first") + 1, size)).drop("results", "page")


def label_impressions(events: DataFrame, results: DataFrame, strict: bool = False) -> DataFrame:
    """One row per result a user saw, labelled 1 for the clicked entity.

    ``events`` has ``user, song, album, playlist, singer, action, keyword, type, timestamp,
    dt, order``; ``results`` has ``keyword, type, results``. The id of the event's own kind is
    replaced by the result. Songs start at the second position, yield nothing if the first
    result is the event's singer or album, and end at the clicked song only from position 11
    on, or at any position with ``strict``; other kinds end at the clicked entity.
    """
    kinds = ["song", "album", "playlist", "singer"]
    # What is the same for all results of an event is told before they are expanded.
    rows = _windows(events, results, strict).withColumns({f"__{kind}": F.col("type") == kind for kind in kinds})
    # The outer form keeps Spark from repeating the whole expression in a filter on its size.
    rows = rows.select("*", F.posexplode_outer("shown").alias("at", "candidate"))
    rows = rows.where(F.col("candidate").isNotNull())
    replaced = {kind: F.when(F.col(f"__{kind}"), F.col("candidate")).otherwise(F.col(kind)) for kind in kinds}
    return rows.select(
        "user",
        *[replaced[kind].alias(kind) for kind in kinds],
        "action",
        "keyword",
        "type",
        "timestamp",
        "dt",
        (F.col("first") + F.col("at")).alias("position"),
        F.coalesce(F.col("candidate") == F.col("clicked"), F.lit(False)).cast("int").alias("label"),
        "order",
    )


def label_stats(events: DataFrame, results: DataFrame, strict: bool = False) -> DataFrame:
    """Counts of a labelling run, from the arrays alone: one row."""
    rows = _windows(events, results, strict)
    hits = F.size(F.filter("shown", lambda c: c == F.col("clicked")))
    return rows.agg(
        F.sum(F.size("shown") - hits).cast("long").alias("negatives"),
        F.sum(hits).cast("long").alias("positives"),
        F.sum("examined").cast("long").alias("examined"),
        F.sum("total").cast("long").alias("candidates"),
    )
