from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from echolane.operators import corpus as C

VOCAB = [("nice", 1, 9), ("song", 2, 8), ("so", 3, 7), ("!", 4, None)]


def vocab(spark, rows=VOCAB):
    return spark.createDataFrame(rows, "word string, id long, freq long")


def sentences(spark, *lists):
    return spark.createDataFrame(list(enumerate(lists)), "k int, tokens array<string>")


def test_vocab_order_marks_and_limits(spark):
    rows = sentences(spark, ["b", "a", "c"], ["a", "b", "d"], ["a", "b", "'"], ["'"])
    freq = C.word_freq(rows)
    assert {r["word"]: r["freq"] for r in freq.collect()} == {"a": 3, "b": 3, "c": 1, "d": 1, "'": 2}
    full = C.build_vocab(freq, 1, ("!", "$"))
    assert sorted((r["id"], r["word"], r["freq"]) for r in full.collect()) == [
        (1, "a", 3), (2, "b", 3), (3, "'", 2), (4, "!", None), (5, "$", None)
    ]
    plain = C.build_vocab(freq, exclude=("'",), drop_top=True)
    assert sorted((r["id"], r["word"]) for r in plain.collect()) == [(2, "b"), (3, "c"), (4, "d")]


def test_context_pairs_keep_the_place_of_unknown_words(spark):
    known = vocab(spark, [("a", 1, 3), ("b", 2, 3), ("!", 3, None), ("$", 4, None)])
    rows = sentences(spark, ["$", "a", "zz", "b", "!"])
    got = {(r["center"], r["context"]): r["n"] for r in C.pair_counts(rows, 1, known).collect()}
    assert got == {(4, 1): 1, (1, 4): 1, (2, 3): 1, (3, 2): 1}


def test_pairs_against_plain_loops(spark):
    lists = [["a", "b", "a", "c"], ["x"], ["a", "a"], ["b"] * 7]
    want = Counter()
    for words in lists:
        for i, word in enumerate(words):
            for j in range(max(0, i - 3), min(len(words), i + 4)):
                if i != j:
                    want[word, words[j]] += 1
    rows = sentences(spark, *lists)
    assert Counter((r["center"], r["context"]) for r in C.context_pairs(rows, 3).collect()) == want
    names = {"a": 1, "b": 2, "c": 3, "x": 4}
    known = vocab(spark, [(word, i, 1) for word, i in names.items()])
    counts = {(r["center"], r["context"]): r["n"] for r in C.pair_counts(rows, 3, known).collect()}
    assert counts == {(names[a], names[b]): n for (a, b), n in want.items()}


def test_lookup_beyond_the_broadcast_head(spark, monkeypatch):
    monkeypatch.setattr(C, "HEAD_WORDS", 2)
    words = ["nice"] * 50 + ["song", "so", "zz"]
    rows = spark.createDataFrame(list(enumerate(words)), "k int, word string")
    known = vocab(spark)
    inner = {r["k"]: r["id"] for r in C.lookup(rows, known, "word", "id").collect()}
    assert inner == {i: {"nice": 1, "song": 2, "so": 3}[w] for i, w in enumerate(words) if w != "zz"}
    left = {r["k"]: r["id"] for r in C.lookup(rows, known, "word", "id", "left").collect()}
    assert left == inner | {52: None}


def test_sentence_text(spark, monkeypatch):
    rows = spark.createDataFrame([(0, [3, 1, 2, 4]), (1, [1, 0, 77])], "k int, ids array<long>")
    for head in (500, 2):
        monkeypatch.setattr(C, "HEAD_WORDS", head)
        got = {r["k"]: r["sentence"] for r in C.sentence_text(rows, ["k"], vocab(spark)).collect()}
        assert got == {0: "so nice song !", 1: "nice"}


def test_encoded_sequences(spark):
    rows = sentences(spark, ["nice", "song"], ["nice", "zz"], ["so", "nice", "zz", "song"], ["nice"] * 25, ["zz", "zz"])
    got = {r["k"]: r["ids"] for r in C.encode_sequences(rows, ["k"], vocab(spark)).collect()}
    assert got == {0: [1, 2, 4] + [0] * 18, 2: [3, 1, 2, 4] + [0] * 17, 3: [1] * 21}


def test_padding_follows_the_longest(spark):
    rows = sentences(spark, ["nice", "song"], ["so", "nice", "song"])
    got = C.lm_examples(C.encode_sequences(rows, ["k"], vocab(spark)))
    assert {r["k"]: (r["ids"], r["targets"]) for r in got.collect()} == {
        0: ([1, 2, 4, 0], [2, 4, 0, 0]),
        1: ([3, 1, 2, 4], [1, 2, 4, 0]),
    }
    primes = C.prime_words(got, ["k"])
    assert {r["k"]: r["prime"] for r in primes.collect()} == {0: 1, 1: 3}


def test_no_sequences_at_all(spark):
    rows = sentences(spark, ["zz", "zz"])
    assert C.encode_sequences(rows, ["k"], vocab(spark)).count() == 0


def test_the_cleaning_appears_once_in_the_plan(spark, capsys):
    rows = spark.createDataFrame([("a b",)], "line string").where(F.length("line") > 0)
    C.tokenize(rows).explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_pair_figures_need_no_row_per_pair(spark):
    rows = [(1, ["b", "a", "b", "c", "a"]), (1, ["d"]), (2, ["e", "e"]), (3, ["x"]), (5, ["p", "q", "r", "p", "s", "p"])]
    lines = spark.createDataFrame(rows, "doc int, tokens array<string>")
    figures = C.pair_figures(lines, 4)
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    pairs = C.context_pairs(lines, 4).groupBy("doc").agg(
        F.count("*"), F.count_if(F.col("center") == F.col("context")), F.min("center"), F.max("context")
    )
    got = figures.groupBy("doc").agg(F.sum("pairs"), F.sum("repeats"), F.min("first_center"), F.max("last_context"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and got.count() == 3


def test_pairs_are_formed_once_beyond_the_head(spark, monkeypatch):
    lists = [["a", "b", "c", "a", "d", "?"], ["d", "d", "c"], ["?", "e"], ["e", "a", "e", "b"] * 3]
    rows, known = sentences(spark, *lists), vocab(spark, [(word, i + 1, 9 - i) for i, word in enumerate("abcde")] + [("!", 6, None)])
    want = sorted(map(tuple, C.pair_counts(rows, 3, known).collect()))
    written = []
    kept = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: written.append(df) or kept(df, name))
    for head in (1, 2, 4):
        monkeypatch.setattr(C, "HEAD_WORDS", head)
        assert sorted(map(tuple, C.pair_counts(rows, 3, known).collect())) == want
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in written]
    assert len(plans) == 3 and all(plan.count("Generate") == 1 for plan in plans)


def test_encoding_deals_out_no_words(spark, monkeypatch):
    """F25 F26 F28: words are looked up inside their sentence; rare ones, equal and missing keys find together."""
    rows = [(1, ["a", "b", "x", "a", "c"]), (1, ["d", "a"]), (None, ["b"]), (None, ["e", "b"]), (2, ["x"]), (3, ["d", "x", "e", "a"]), (4, [])]
    sentences = spark.createDataFrame(rows, "id long, tokens array<string>")
    vocab = spark.createDataFrame([(w, i + 1, 9 - i) for i, w in enumerate("abcde")], "word string, id long, freq long")
    want = {1: [1, 4, 1, 2, 1, 3], None: [2, 5, 2], 3: [4, 5, 1]}
    for head in (500_000, 2):
        monkeypatch.setattr(C, "HEAD_WORDS", head)
        got = C.encode(sentences, ["id"], vocab).collect()
        assert {r["id"]: r["ids"] for r in got} == want and len(got) == 3
        got = C.encode(sentences, ["id"], vocab, 2).collect()
        assert {r["id"]: r["ids"] for r in got} == {k: v[:2] for k, v in want.items()}
    monkeypatch.undo()
    plan = C.encode(sentences.where("id > 1"), ["id"], vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_pairs_are_added_up_before_they_are_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "_MET_ROWS", 2)
    words = ["a", "b", "é", "d"]
    vocab = spark.createDataFrame([(w, i + 1, 9 - i) for i, w in enumerate(words)], "word string, id long, freq long")
    sentences = [["a", "b", "zz", "a", "a", None, "é"], ["d"], [], ["é", "d", "d", "zz", "a"], ["a", "b", "zz", "a", "a", None, "é"]]
    want = Counter()
    for tokens in sentences:
        for i, j in permutations(range(len(tokens)), 2):
            if abs(i - j) <= 2 and tokens[i] in words and tokens[j] in words:
                want[words.index(tokens[i]) + 1, words.index(tokens[j]) + 1] += 1
    pairs = C.pair_counts(spark.createDataFrame([(s,) for s in sentences], "tokens array<string>"), 2, vocab)
    assert {(r["center"], r["context"]): r["n"] for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashJoin" not in plan and "Generate explode" not in plan
