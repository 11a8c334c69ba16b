import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echolane.operators import nextword as N

END = 9
SENTENCES = [[1, 2, 3, END], [1, 2, 4, END], [1, 2, 3, END, 0, 0], [2, 2, 5, END], [1, 6, 7, 8, 3]]


def sequences(spark, rows=SENTENCES):
    return spark.createDataFrame(list(enumerate(rows)), "id long, ids array<long>")


def counted(order):
    out = Counter()
    for row in SENTENCES:
        words = [w for w in row if w]
        for i in range(order, len(words)):
            out[" ".join(map(str, words[i - order : i])), words[i]] += 1
    return out


def test_model(spark):
    rows = N.ngram_model(sequences(spark), 4).collect()
    for order in (1, 2, 3):
        mine = {(r["context"], r["next"]): r["n"] for r in rows if r["order"] == order}
        assert mine == counted(order)
    sums = Counter()
    for r in rows:
        sums[r["order"], r["context"]] += r["p"]
    assert all(total == pytest.approx(1.0) for total in sums.values())


def test_short_sequences(spark):
    assert N.ngram_model(sequences(spark, [[1], [], [1, 2]]), 3).count() == 1


def test_top_words(spark):
    rows = [[1, w] for w, n in ((2, 4), (3, 3), (4, 3), (5, 1), (END, 5)) for _ in range(n)]
    best = N.next_word_topn(N.ngram_model(sequences(spark, rows), 2), END).collect()
    late = {r["rank"]: (r["next"], r["p"]) for r in best if r["can_end"]}
    early = {r["rank"]: (r["next"], r["p"]) for r in best if not r["can_end"]}
    assert late == {1: (END, pytest.approx(5 / 12)), 2: (2, pytest.approx(4 / 12)), 3: (3, pytest.approx(3 / 12))}
    assert early == {1: (2, pytest.approx(0.4)), 2: (3, pytest.approx(0.3)), 3: (4, pytest.approx(0.3))}


def test_generated_sentences(spark):
    model = N.ngram_model(sequences(spark), 2)
    primes = spark.range(200).select("id", (F.col("id") % 8 + 1).alias("prime"))
    got = {r["id"]: r["ids"] for r in N.generate(primes, ["id"], model, END, seed=3).collect()}
    assert sorted(got) == list(range(200))
    steps = counted(1)
    for key, ids in got.items():
        assert ids[0] == key % 8 + 1 and len(ids) <= 21
        assert all(steps[str(a), b] > 0 and a != b for a, b in zip(ids, ids[1:]))
        assert END not in ids[:-1] and END not in ids[1:5]
    again = {r["id"]: r["ids"] for r in N.generate(primes.repartition(3), ["id"], model, END, seed=3).collect()}
    assert again == got
    assert got != {r["id"]: r["ids"] for r in N.generate(primes, ["id"], model, END, seed=4).collect()}


def test_endless_words_stop_after_twenty_steps(spark):
    model = N.ngram_model(sequences(spark, [[1, 2, 1, 2, 1]]), 2)
    got = N.generate(spark.createDataFrame([(0, 1), (1, 7)], "id long, prime long"), ["id"], model, END).collect()
    assert {r["id"]: len(r["ids"]) for r in got} == {0: 21, 1: 1}


def test_scores(spark):
    model = N.ngram_model(sequences(spark), 2)
    got = {r["id"]: (r["words"], r["log_prob"]) for r in N.score_sentences(sequences(spark), ["id"], model).collect()}
    steps, total = counted(1), Counter()
    for (context, _), n in steps.items():
        total[context] += n
    for key, row in enumerate(SENTENCES):
        words = [w for w in row if w]
        want = sum(math.log(steps[str(a), b] / total[str(a)]) for a, b in zip(words, words[1:]))
        assert got[key] == (len(words) - 1, pytest.approx(want))
    unseen = N.score_sentences(sequences(spark, [[5, 1]]), ["id"], model).first()
    assert unseen["log_prob"] == float("-inf")


def test_cross_entropy(spark):
    model = N.ngram_model(sequences(spark), 2)
    held = [[1, 2, 9], [7, 7], [42, 1]]
    steps, total = counted(1), Counter()
    for (context, _), n in steps.items():
        total[context] += n
    terms = [-math.log((steps[str(a), b] + 1) / (total[str(a)] + 9)) for row in held for a, b in zip(row, row[1:])]
    got = N.cross_entropy(sequences(spark, held), model, 9).first()
    assert got["cross_entropy"] == pytest.approx(sum(terms) / len(terms))
    assert got["perplexity"] == pytest.approx(math.exp(sum(terms) / len(terms)))


def test_the_model_reads_whole_sentences(spark):
    """Counts of the first order are as many as the known words of the whole corpus."""
    from checks import inputs

    sentences, vocab = inputs.whole_sentences(spark, "/root/testdata/sf0.001")
    model = N.ngram_model(sentences, 2)
    known = vocab.where("freq IS NOT NULL").agg(F.sum("freq")).first()[0]
    assert model.where("order = 1").agg(F.sum("n")).first()[0] == known
    assert sentences.agg(F.max(F.size("ids"))).first()[0] > 22


def test_rows_beyond_the_head_are_not_doubled_by_every_step(spark, monkeypatch):
    model = N.ngram_model(sequences(spark), 2)
    primes = spark.range(50).select("id", (F.col("id") % 8 + 1).alias("prime"))
    want = sorted(map(tuple, N.generate(primes, ["id"], model, END, seed=3).collect()))
    written = []
    kept = N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, name: written.append(df) or kept(df, name))
    monkeypatch.setattr(N, "HEAD_WORDS", 2)
    assert sorted(map(tuple, N.generate(primes, ["id"], model, END, seed=3).collect())) == want
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in written[1:]]
    assert max(joins) <= 3


def test_only_numbers_travel_to_their_context(spark):
    """F10 F17: contexts are made into text where they are counted, and long ones travel once."""
    rows = sequences(spark)
    for made in (N.ngram_model(rows, 3), N.top_next_words(rows, 3, END)):
        plan = made._jdf.queryExecution().optimizedPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
        assert dealt and not any("context" in line or "order" in line for line in dealt)
        assert sum("hashpartitioning(w2" in line for line in dealt) == 1


def test_top_words_of_sequences_are_those_of_the_model(spark):
    want = N.next_word_topn(N.ngram_model(sequences(spark), 4), END)
    got = N.top_next_words(sequences(spark), 4, END)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_totals_beyond_the_head(spark, monkeypatch):
    want = sorted(map(tuple, N.ngram_model(sequences(spark), 3).collect()))
    monkeypatch.setattr(N, "HEAD_WORDS", 2)
    assert sorted(map(tuple, N.ngram_model(sequences(spark), 3).collect())) == want


def test_scores_with_a_small_head(spark, monkeypatch):
    """F18 F19: steps that are not among the frequent ones, and rows without a key."""
    rows = spark.createDataFrame([(None, [1, 2, 3, END]), (None, [2, 2]), (5, [1, 2, 4, END, 7])], "id long, ids array<long>")
    model = N.ngram_model(sequences(spark), 2)
    want = {r["id"]: (r["words"], r["log_prob"]) for r in N.score_sentences(rows, ["id"], model).collect()}
    monkeypatch.setattr(N, "HEAD_WORDS", 2)
    got = {r["id"]: (r["words"], r["log_prob"]) for r in N.score_sentences(rows, ["id"], model).collect()}
    assert got[None] == (4, pytest.approx(want[None][1])) and got[5] == (4, float("-inf")) == want[5]
