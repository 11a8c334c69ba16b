from pyspark.sql import functions as F

from echolane.functions.scalars import not_self
from echolane.plans.comment_job import comments_of_day, write_comments
from echolane.operators import comments as K

DAY, OTHER = "20180730", "20180729"
ROBOT = (5 << 48) + 1


def tables(spark):
    users = spark.createDataFrame(
        [(1, "IN", DAY), (1, "IN", DAY), (2, "IN", DAY), (3, "US", DAY), (ROBOT, "IN", DAY), (4, "IN", OTHER)],
        "user_id long, country_code string, dt string",
    )
    comments = spark.createDataFrame(
        [
            (10, 1, 100, 0, "kept", DAY),
            (11, 1, 101, 0, "own recording", DAY),
            (12, 2, 102, 0, "no owner", DAY),
            (13, 3, 100, 0, "other country", DAY),
            (14, ROBOT, 100, 0, "robot", DAY),
            (15, 1, 100, 0, "no reply", DAY),
            (16, 1, 100, 10, "a reply", DAY),
            (17, 1, 103, 0, "kind 3", DAY),
            (18, 1, 100, 0, "reply on another day", DAY),
            (19, 4, 100, 0, "not active that day", DAY),
            (90, 7, 1, 10, "r", DAY), (91, 7, 1, 11, "r", DAY), (92, 7, 1, 12, "r", DAY), (93, 7, 1, 13, "r", DAY),
            (94, 7, 1, 14, "r", DAY), (95, 7, 1, 16, "r", DAY), (96, 7, 1, 17, "r", DAY), (97, 7, 1, 18, "r", OTHER),
            (98, 7, 1, 19, "r", DAY), (99, 7, 1, 10, "r", DAY),
        ],
        "id long, user_id long, recording_id long, parent_id long, comment string, dt string",
    )
    recordings = spark.createDataFrame(
        [(100, 9, 1, DAY), (101, 1, 2, DAY), (102, None, 8, DAY), (103, 9, 3, DAY), (100, 9, 7, DAY), (100, 9, 5, OTHER)],
        "id long, user_id long, media_type int, dt string",
    )
    return users, comments, recordings


def test_groups(spark):
    got = comments_of_day(*tables(spark), "IN", DAY).collect()
    assert sorted((r["media_type"], r["id"], r["comment"]) for r in got) == [
        (1, 10, "kept"), (7, 10, "kept"), (8, 12, "no owner")
    ]


def test_one_folder_per_kind(spark, tmp_path):
    write_comments(comments_of_day(*tables(spark), "IN", DAY), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["media_type=1", "media_type=7", "media_type=8"]
    assert spark.read.text(str(tmp_path / "out" / "media_type=8")).first()[0] == "no owner"


def test_a_missing_owner_is_somebody_else(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, None)], "a long, b long")
    assert [r[0] for r in rows.select(not_self(F.col("a"), F.col("b"))).collect()] == [False, True, True]


def test_membership_split(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "u string, i int")
    yes, no = K.split_by_membership(rows, spark.createDataFrame([("a",), ("a",)], "u string"), "u")
    assert sorted(r["i"] for r in yes.collect()) == [1, 3]
    assert [r["i"] for r in no.collect()] == [2]


def test_hot_recording(spark):
    """A third of all comments sits on one recording and comes from one user."""
    n = 3000
    openers = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") < n // 3, F.lit(1)).otherwise(F.col("id") + 10).cast("long").alias("user_id"),
        F.when(F.col("id") < n // 3, F.lit(5)).otherwise(F.col("id")).cast("long").alias("recording_id"),
        F.lit("c").alias("comment"),
    )
    users = openers.select("user_id").distinct()
    recordings = spark.range(n).select("id", F.lit(0).cast("long").alias("user_id"), F.lit(1).alias("media_type"))
    assert K.comment_groups(users, openers, openers.select("id"), recordings).count() == n
