import random

import pytest

from echolane.operators import searchlog as L

LONG = list(range(100, 115))
TWELVE = list(range(200, 212))

# kind, action, clicked, singer, album, results, expected (candidate, position, label)
GOLDEN = [
    ("songs", "click", 20, 5, 7, [90, 10, 20, 30], [(10, 1, 0), (20, 2, 1), (30, 3, 0)]),
    ("song", "click", 20, 90, 7, [90, 10, 20, 30], []),
    ("song", "click", 20, 5, 90, [90, 10, 20, 30], []),
    ("song", "click", 20, 5, 7, [20, 10, 30], [(10, 1, 0), (30, 2, 0)]),
    ("song", "click", 112, 5, 7, LONG, [(100 + i, i, 0) for i in range(1, 12)] + [(112, 12, 1)]),
    ("song", "click", 110, 5, 7, LONG, [(100 + i, i, int(i == 10)) for i in range(1, 15)]),
    ("song", "show", 112, 5, 7, LONG, [(100 + i, i, 0) for i in range(1, 10)]),
    ("albums", "click", 20, 5, 20, [90, 10, 20, 30], [(90, 0, 0), (10, 1, 0), (20, 2, 1)]),
    ("singer", "show", 20, 20, 7, TWELVE, [(200 + i, i, 0) for i in range(10)]),
    ("playlists", "click", 20, 5, 7, [20, 30], []),
    ("playlist", "click", 20, 5, 7, [20, 30], [(20, 0, 1)]),
    ("song", "play", 20, 5, 7, [90, 10, 20], []),
]
EVENT = "user long, song long, album long, playlist long, singer long, action string, keyword string, type string, timestamp string, dt string, order long"
RESULTS = "keyword string, type string, results array<long>"


def event(kind, action, clicked, singer, album, order):
    song = clicked if kind in ("song", "songs") else 1
    playlist = clicked if kind.startswith("playlist") else 2
    return (9, song, album, playlist, singer, action, f"k{order}", kind, "t", "20180101", order)


@pytest.fixture(scope="module")
def golden(spark):
    events = [event(*case[:5], i) for i, case in enumerate(GOLDEN)]
    results = [(f"k{i}", kind, case[5]) for i, case in enumerate(GOLDEN) for kind in ("song", "album", "singer", "playlist", "playlists")]
    return spark.createDataFrame(events, EVENT), spark.createDataFrame(results, RESULTS)


def entity(row):
    return row[row["type"]]


def test_golden_cases(golden):
    got = {i: [] for i in range(len(GOLDEN))}
    for row in L.label_impressions(*golden).collect():
        got[row["order"]].append((entity(row), row["position"], row["label"]))
    assert {i: sorted(rows, key=lambda r: r[1]) for i, rows in got.items()} == {i: case[6] for i, case in enumerate(GOLDEN)}


def test_only_the_own_kind_is_replaced(golden):
    row = L.label_impressions(*golden).where("order = 10").first()
    assert (row["user"], row["song"], row["album"], row["singer"], row["playlist"]) == (9, 1, 7, 5, 20)


def test_strict_songs_stop_at_the_match(golden):
    rows = L.label_impressions(*golden, strict=True).where("order = 0").collect()
    assert sorted((r["song"], r["position"], r["label"]) for r in rows) == [(10, 1, 0), (20, 2, 1)]


def by_hand(kind, action, clicked, singer, album, results):
    """Rows, and the figures examined and candidates, of one event, straight from the rules."""
    kind = {"songs": "song", "albums": "album", "singers": "singer"}.get(kind, kind)
    seen = results[: {"click": 100, "show": 10}.get(action, 0)]
    rows, looked = [], 0
    for i, result in enumerate(seen if kind in ("song", "album", "playlist", "singer") else []):
        looked += 1
        if kind == "song" and i == 0:
            if result in (singer, album):
                break
            continue
        rows.append((result, i, int(result == clicked)))
        if result == clicked and (kind != "song" or i > 10):
            break
    return rows, looked, len(seen)


def test_random_events_and_figures(spark):
    draw = random.Random(11)
    cases = []
    for _ in range(300):
        kind = draw.choice(["song", "songs", "album", "singer", "singers", "playlist", "playlists"])
        results = draw.sample(range(120), draw.choice([0, 1, 3, 12, 40, 110]))
        singer, album = draw.randrange(120), draw.randrange(120)
        clicked = draw.randrange(120)
        clicked = {"album": album, "singer": singer, "singers": singer}.get(kind, clicked)
        cases.append((kind, draw.choice(["click", "show", "other"]), clicked, singer, album, results))
    events = spark.createDataFrame([event(*case[:5], i) for i, case in enumerate(cases)], EVENT)
    kinds = ("song", "album", "singer", "playlist", "playlists")
    results = spark.createDataFrame([(f"k{i}", k, case[5][:100]) for i, case in enumerate(cases) for k in kinds], RESULTS)
    got = {i: [] for i in range(len(cases))}
    for row in L.label_impressions(events, results).collect():
        got[row["order"]].append((entity(row), row["position"], row["label"]))
    want = [by_hand(*case[:5], case[5][:100]) for case in cases]
    assert {i: sorted(rows, key=lambda r: r[1]) for i, rows in got.items()} == {i: w[0] for i, w in enumerate(want)}
    figures = L.label_stats(events, results).first().asDict()
    hits = sum(row[2] for w in want for row in w[0])
    assert figures == {
        "negatives": sum(len(w[0]) for w in want) - hits,
        "positives": hits,
        "examined": sum(w[1] for w in want),
        "candidates": sum(w[2] for w in want),
    }


def test_keyword_without_results(spark, golden):
    events, results = golden
    assert L.label_impressions(events, results.where("keyword = 'none'")).count() == 0
