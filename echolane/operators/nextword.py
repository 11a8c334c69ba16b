"""Next-word behaviour of a corpus from counts: model, generation, sentence scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..session import materialise
from .corpus import HEAD_WORDS, match
from .order import heavy_from, top_n

# Choices per word, words per sentence, steps in which a sentence may not end.
CHOICES, STEPS, OPEN_STEPS = 3, 20, 4

# Joins in one plan before a generation run is written down.
STEPS_PER_STAGE = 5


def _steps(sequences: DataFrame, order: int, ids: str = "ids") -> DataFrame:
    """Every word ``next`` that has ``order`` words before it, with these as numbers ``w{order} … w1``, oldest first."""
    kept = sequences.select(*[c for c in sequences.columns if c != ids], F.array_remove(ids, 0).alias(ids))
    count = F.greatest(F.size(ids) - order, F.lit(0))
    names = [*_context(order), "next"]
    zipped = F.arrays_zip(*[F.slice(ids, i + 1, count).alias(name) for i, name in enumerate(names)])
    return kept.select(*[c for c in kept.columns if c != ids], F.inline(zipped).alias(*names))


def _context(order: int) -> list[str]:
    return [f"w{i}" for i in range(order, 0, -1)]


def _named(order: int) -> list[Column]:
    """``order, context``: the ids as text, oldest first."""
    return [F.lit(order).alias("order"), F.concat_ws(" ", *[F.col(w).cast("string") for w in _context(order)]).alias("context")]


def transitions(sequences: DataFrame, n: int, ids: str = "ids") -> DataFrame:
    """Every word with the up to ``n - 1`` words before it: ``order, context, next``.

    ``context`` holds the ids as text, oldest first. The filler id 0 takes no part.
    """
    others = [c for c in sequences.columns if c != ids]
    return reduce(DataFrame.unionByName, [_steps(sequences, j, ids).select(*others, *_named(j), "next") for j in range(1, n)])


def _counts(sequences: DataFrame, order: int, ids: str = "ids") -> DataFrame:
    """How often each word follows each context: ``w{order} … w1, next, n``.

    Numbers travel, not text. Contexts of several words repeat too little to be added up before they
    travel, so these go straight to the place of their context, where all that follows needs no
    shuffle. The steps of one word, some very frequent, are added up first.
    """
    steps = _steps(sequences.select(ids), order, ids)
    if order > 1:
        steps = steps.repartition(*_context(order))
    return _counted(steps, order)


def _counted(steps: DataFrame, order: int) -> DataFrame:
    return steps.groupBy(*_context(order), "next").agg(F.count(F.lit(1)).alias("n"))


def ngram_model(sequences: DataFrame, n: int = 3, ids: str = "ids") -> DataFrame:
    """``order, context, next, n, total, p``: counts and share of each word after a context."""
    parts = [_with_total(_counts(sequences, order, ids), order) for order in range(2, n)]
    if n > 1:
        # What a frequent word is followed by is spread; its total is a row of a table of fixed size.
        steps = _steps(sequences.select(ids), 1, ids)
        frequent, seldom = steps.where(F.col("w1") <= HEAD_WORDS), steps.where(F.col("w1") > HEAD_WORDS)
        totals = frequent.groupBy("w1").agg(F.count(F.lit(1)).alias("total"))
        parts.append(_counted(frequent, 1).join(F.broadcast(totals), "w1"))
        parts.append(_with_total(_counted(seldom.repartition("w1"), 1), 1))
    orders = [*range(2, n), 1, 1]
    share = (F.col("n") / F.col("total")).alias("p")
    return reduce(DataFrame.unionByName, [part.select(*_named(order), "next", "n", "total", share) for part, order in zip(parts, orders)])


def _with_total(counts: DataFrame, order: int) -> DataFrame:
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*_context(order))))


def next_word_topn(model: DataFrame, end_id: int, n: int = CHOICES) -> DataFrame:
    """The ``n`` likeliest words after each context, with shares that add up to one.

    ``can_end`` tells the lists that may hold the end mark from those that may not.
    """
    return _best(model, ["order", "context"], end_id, n)


def top_next_words(sequences: DataFrame, orders: int, end_id: int, n: int = CHOICES, ids: str = "ids") -> DataFrame:
    """``next_word_topn`` of the ``ngram_model`` of sequences, picked where their steps are counted."""
    parts = []
    for order in range(1, orders):
        best = _best(_counts(sequences, order, ids), _context(order), end_id, n)
        parts.append(best.select(*_named(order), "next", "n", "can_end", "rank", "p"))
    return reduce(DataFrame.unionByName, parts)


def _best(model: DataFrame, group: list[str], end_id: int, n: int) -> DataFrame:
    # The end mark takes one place at most, so the first n + 1 hold both lists.
    rows = top_n(model.select(*group, "next", "n"), group, [F.col("n").desc(), F.col("next").asc()], n + 1, "place")
    whole, place, is_end = Window.partitionBy(*group), F.col("place"), F.col("next") == end_id
    rows = rows.withColumns(
        {
            "end_at": F.coalesce(F.min(F.when(is_end, place)).over(whole), F.lit(n + 2)),
            "open_sum": F.sum(F.when(place <= n, F.col("n"))).over(whole),
            "closed_sum": F.sum(F.when(~is_end, F.col("n"))).over(whole),
        }
    )
    # Without the end mark, those behind it move up.
    end_at = F.col("end_at")
    closed = F.when(place < end_at, place).when(place > end_at, place - 1)
    closed_sum = F.when(end_at <= n + 1, F.col("closed_sum")).otherwise(F.col("open_sum"))
    lists = F.array(
        F.struct(F.lit(True).alias("can_end"), place.alias("rank"), (F.col("n") / F.col("open_sum")).alias("p")),
        F.struct(F.lit(False).alias("can_end"), closed.alias("rank"), (F.col("n") / closed_sum).alias("p")),
    )
    return rows.select(*group, "next", "n", F.inline(lists)).where(F.col("rank") <= n)


def _choice_lists(model: DataFrame, end_id: int, n: int) -> DataFrame:
    """Per word and ``can_end`` the choices other than the word itself, with running counts."""
    best = next_word_topn(model.where("order = 1"), end_id, n)
    best = best.withColumn("context", F.col("context").cast("long")).where("next != context")
    group = ["context", "can_end"]
    upto = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    best = best.withColumn("upto", F.sum("n").over(upto))
    lists = best.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("upto", "next"))).alias("choices"), F.sum("n").alias("weight")
    )
    # Word ids are frequency ranks, so most sentences stand at a word of the head.
    return lists.withColumn("__head", F.col("context") <= HEAD_WORDS)


def generate(
    primes: DataFrame, key: list[str], model: DataFrame, end_id: int, steps: int = STEPS, seed: int = 7, n: int = CHOICES
) -> DataFrame:
    """Sentences of up to ``steps`` words after a first word: ``key…, ids``.

    ``primes`` has ``key…, prime``. Each step draws one of the ``n`` likeliest next words by its
    count, never the last word again, and no end mark in the first steps. A sentence ends
    with the end mark or where no choice is left. All sentences advance together.
    """
    choices = materialise(_choice_lists(model, end_id, n), "choices")
    # A look-up beyond the head reads its rows twice, so steps in one plan would double them each time.
    stage = STEPS_PER_STAGE if choices.where("NOT __head").isEmpty() else 1
    running = primes.select(*key, F.array("prime").alias("ids"), F.col("prime").alias("last"))
    finished: list[DataFrame] = []
    for step in range(steps):
        running = _advance(running, key, choices, end_id, seed, step)
        if (step + 1) % stage == 0 or step + 1 == steps:
            saved = materialise(running, "sentences")
            finished.append(saved.where("last is null").select(*key, "ids"))
            running = saved.where("last is not null")
    finished.append(running.select(*key, "ids"))
    return reduce(DataFrame.unionByName, finished)


def _advance(running: DataFrame, key: list[str], choices: DataFrame, end_id: int, seed: int, step: int) -> DataFrame:
    """One more word for every sentence that has not ended (``last`` is its last word, or null)."""
    lists = choices.where(F.col("can_end") == F.lit(step >= OPEN_STEPS)).select("context", "choices", "weight", "__head")
    # An ended sentence gets a key of its own that matches nothing, so that they do not pile up.
    keyed = running.withColumn("context", F.coalesce("last", -1 - F.abs(F.xxhash64(*key))))
    met = match(keyed, lists, "context", "left")
    draw = F.pmod(bucket(seed, *map(F.col, key), F.lit(step)), F.col("weight"))
    picked = F.get(F.filter("choices", lambda c: c["upto"] > draw), F.lit(0))["next"]
    met = met.select(*key, "ids", picked.alias("picked"))
    grown = F.when(F.col("picked").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array("picked")))
    last = F.when(F.col("picked") != end_id, F.col("picked"))
    return met.select(*key, grown.alias("ids"), last.alias("last"))


def _first_order(model: DataFrame) -> DataFrame:
    return model.where("order = 1").withColumn("w1", F.col("context").cast("long"))


def score_sentences(sequences: DataFrame, key: list[str], model: DataFrame, ids: str = "ids") -> DataFrame:
    """Log probability of each sentence after its first word: ``key…, words, log_prob``."""
    steps = _steps(sequences.select(*key, ids), 1, ids)
    pairs = materialise(_first_order(model).select("w1", "next", "n", F.log(F.col("n") / F.col("total")).alias("share")), "steps")
    # Frequent steps are looked up where they stand; only the others meet the rest of the model by shuffle.
    least = heavy_from(pairs, "n", HEAD_WORDS)
    frequent = F.lit(False) if least is None else F.col("n") >= least
    met = steps.join(F.broadcast(pairs.where(frequent).drop("n")), ["w1", "next"], "left")
    rare = met.where("share IS NULL").drop("share").join(pairs.where(~frequent).drop("n"), ["w1", "next"], "left")
    rare = rare.withColumn("share", F.coalesce("share", F.lit(float("-inf"))))
    known = met.where("share IS NOT NULL").select(*key, "share").unionByName(rare.select(*key, "share"))
    return known.groupBy(*key).agg(F.count(F.lit(1)).alias("words"), F.sum("share").alias("log_prob"))


def cross_entropy(sequences: DataFrame, model: DataFrame, words: int, ids: str = "ids") -> DataFrame:
    """Mean of -ln p over all next words, with add-one counts, and its exponential: one row.

    ``words`` is the number of words a next word can be. Equal steps are added up before they
    meet the model.
    """
    steps = _steps(sequences.select(ids), 1, ids).groupBy("w1", "next").agg(F.count(F.lit(1)).alias("times"))
    pairs = materialise(_first_order(model).select("w1", "next", "n", "total"), "pairs")
    totals = pairs.groupBy("w1").agg(F.max("total").alias("total"))
    met = steps.join(pairs.select("w1", "next", "n"), ["w1", "next"], "left").join(totals, "w1", "left")
    share = F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.coalesce("total", F.lit(0)) + words))
    mean = F.sum(-share * F.col("times")) / F.sum("times")
    return met.agg(mean.alias("cross_entropy")).withColumn("perplexity", F.exp("cross_entropy"))
