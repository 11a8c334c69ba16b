import math
import random
from collections import Counter

import pytest

from echolane.operators import searchlog as L
from echolane.sources.tables import day_scan, trailing_days

WORDS = ["love"] * 12 + ["song", "night", "blue", "moon", "rain", "fire"]


@pytest.fixture(scope="module")
def fixture():
    draw = random.Random(5)
    names = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 6))) for _ in range(400)]
    asked = {" ".join(draw.choice(WORDS + ["unknown"]) for _ in range(draw.randrange(1, 8))) for _ in range(60)}
    return names, sorted(asked | {"love", "unknown", "Love  SONG"})


def by_hand(names, query, k):
    entries = [set(n.lower().split()) for n in names]
    df = Counter(w for e in entries for w in e)
    weight = {w: math.log1p(len(entries) / n) for w, n in df.items()}
    words = set(query.lower().split())
    scored = [(round(sum(weight[w] for w in words & e), 9), i) for i, e in enumerate(entries) if words & e]
    return [i for _, i in sorted(scored, key=lambda s: (-s[0], s[1]))[:k]]


def answers(spark, names, asked, k, block):
    catalog = spark.createDataFrame([(i, "song", n) for i, n in enumerate(names)], "id long, type string, name string")
    queries = spark.createDataFrame([(q, "song") for q in asked] * 2, "keyword string, type string")
    found = L.keyword_search(queries, catalog, k, block)
    return {r["keyword"]: r["results"] for r in L.result_lists(found).collect()}


@pytest.mark.parametrize("block, set_words", [(1024, 6), (16, 1), (3, 2)])
def test_search_against_scoring_everything(spark, fixture, block, set_words, monkeypatch):
    monkeypatch.setattr(L, "SET_WORDS", set_words)
    names, asked = fixture
    assert answers(spark, names, asked, 7, block) == {q: by_hand(names, q, 7) for q in asked if by_hand(names, q, 7)}


def test_long_queries_of_hot_words(spark):
    """Twelve and more words, all of them in more entries than a page holds."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(24)]
    names = [" ".join(draw.sample(words[:12] if i < 300 else words, draw.randrange(1, 7))) for i in range(600)]
    asked = [" ".join(draw.sample(words, n)) for n in (7, 8, 12, 12, 16, 20, 24)] + [" ".join(words[:12]), "w3", "w3 w4"]
    assert answers(spark, names, asked, 5, 10) == {q: by_hand(names, q, 5) for q in asked}


def test_entries_are_not_put_in_order_for_short_queries(spark, fixture, monkeypatch):
    sorts, kept = [], L.with_index
    monkeypatch.setattr(L, "with_index", lambda *a: sorts.append(a) or kept(*a))
    names, asked = fixture
    short = [q for q in asked if len(set(q.lower().split())) <= L.SET_WORDS]
    assert answers(spark, names, short, 7, 16) == {q: by_hand(names, q, 7) for q in short if by_hand(names, q, 7)}
    assert not sorts
    long = "love song night blue moon rain fire"
    assert answers(spark, names, [long], 7, 16) == {long: by_hand(names, long, 7)} and len(sorts) == 1


def test_few_blocks_are_looked_into(spark, monkeypatch):
    """Entries that share the words of a query stand together; the other blocks are left alone."""
    names = [f"a{i // 50} b{i // 50} common other" if i % 2 else f"a{i // 50} common" for i in range(2000)]
    asked = ["a7 b7 common other x y z u v", "a9 b8 common other w1 w2 w3"]
    looked = []
    kept = L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, name: looked.append(kept(df, name)) or looked[-1] if name == "looked" else kept(df, name))
    assert answers(spark, names, asked, 10, 10) == {q: by_hand(names, q, 10) for q in asked}
    assert sum(df.count() for df in looked) <= 24  # of 200 blocks for either query


def test_days(spark):
    days = ["20180225", "20180226", "20180228", "20180301", "20180304", "20180305"]
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "dt string, i int")
    assert [r["dt"] for r in trailing_days(rows, "20180304").orderBy("dt").collect()] == days[1:5]
    assert [r["dt"] for r in trailing_days(rows, "20180304", 1).collect()] == ["20180304"]
    assert [r["i"] for r in day_scan(rows, "20180301", ["i"]).collect()] == [3]


def test_only_the_wanted_days_are_read(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("20180301", 1), ("20180302", 2), ("20180309", 3)], "dt string, i int")
    rows.write.partitionBy("dt").parquet(str(tmp_path / "t"))
    table = spark.read.schema("i int, dt string").parquet(str(tmp_path / "t"))
    trailing_days(table, "20180304", 7).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(dt" in plan and "20180226" in plan


def test_collect_and_number(spark):
    schema = "user_id long, song_id long, album_id long, playlist_id long, singer_id long, type string, dt string, timestamp string"
    rows = [
        (1, None, 2, None, 4, "search", "20180101", "a"),
        (2, 1, 2, 3, 4, "search", "20180102", "b"),
        (3, 1, 2, 3, 4, "search", "20180102", "a"),
        (1, 1, 2, 3, 4, "play", "20180102", "c"),
        (None, 1, 2, 3, 4, "search", "20180102", "c"),
    ]
    users = spark.createDataFrame([(1,), (1,), (2,), (-1,)], "user_id long")
    got = L.sequence_id(L.collect_events(spark.createDataFrame(rows, schema), users), "user_id").orderBy("order").collect()
    assert [(r["order"], r["user_id"], r["song_id"], r["playlist_id"]) for r in got] == [(0, 2, 1, 3), (1, -1, 1, 3), (2, 1, -1, -1)]
