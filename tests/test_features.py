import math

import pytest

from echolane.operators import features as E


def events(spark, rows):
    schema = "user long, song long, album long, playlist long, singer long, action string, keyword string, type string, timestamp string, dt string, position int, label int, order long"
    return spark.createDataFrame(rows, schema)


def test_names_and_figures(spark):
    rows = events(
        spark,
        [
            (1, 10, 2, 3, 4, "click", "k", "song", "t", "20180101", 1, 1, 0),
            (1, 11, 2, 3, 4, "click", "k", "song", "t", "20180101", 2, 0, 0),
            (1, 10, 2, 3, 4, "click", "k", "song", "t", "20180102", 3, 0, 0),
            (1, 10, 2, 3, 4, "click", "k", "album", "t", "20180101", 4, 0, 0),
        ],
    )
    names = spark.createDataFrame([(10, "n", None, "s")], "song long, name string, album_name string, singer_name string")
    stats = spark.createDataFrame([(10, "20180101", 0, 1, 9, 9, 9)], "song long, dt string, " + ", ".join(f"{c} long" for c in E.COUNTERS))
    got = {r["position"]: r for r in E.enrich(rows, "song", names, stats).collect()}
    assert set(got) == {1, 2, 3}
    assert len(got[1]) == 18
    assert (got[1]["name"], got[1]["album_name"], got[1]["singer_name"]) == ("n", "0", "s")
    assert [got[1][c] for c in E.COUNTERS] == pytest.approx([0.0, math.log(2), math.log(10), math.log(10), math.log(10)])
    assert (got[2]["name"], got[2]["play_num"], got[3]["comment_num"], got[3]["name"]) == ("0", 0.0, 0.0, "n")


@pytest.mark.parametrize("kind", ["singer", "album", "playlist"])
def test_other_kinds(spark, kind):
    rows = events(spark, [(1, 1, 2, 3, 4, "show", "k", kind, "t", "20180101", 0, 1, 0)])
    key = {"album": 2, "playlist": 3, "singer": 4}[kind]
    names = spark.createDataFrame([(key, "n")], f"{kind} long, name string")
    stats = spark.createDataFrame([(key, "20180101", 1, 1, 1, 1, None)], f"{kind} long, dt string, " + ", ".join(f"{c} long" for c in E.COUNTERS))
    row = E.enrich(rows, kind, names, stats).first()
    assert (row[kind], row["name"], row["play_num"], row["comment_num"]) == (key, "n", pytest.approx(math.log(2)), 0.0)
