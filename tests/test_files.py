import pytest

from echolane import session
from echolane.sources import sinks, text_files as X


def lines(spark, path, *rows):
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(str(path))
    return str(path)


def test_events_of_another_width_are_left_out(spark, tmp_path):
    good = "@+@".join(["1", "2", "3", "4", "5", "click", "k", "song", "t", "20180101", "0"])
    short, long = "@+@".join(["1"] * 10), "@+@".join(["1"] * 12)
    path = lines(spark, tmp_path / "e", f"  {good} ", short, long, "")
    got = X.read_delimited(spark, path, X.EVENT_DELIMITER, X.EVENT_SCHEMA).collect()
    assert [tuple(r) for r in got] == [tuple(good.split("@+@"))]
    assert X.rejected_lines(spark, path, X.EVENT_DELIMITER, X.EVENT_SCHEMA).first()[0] == 3


def test_typed_fields(spark, tmp_path):
    good = ["1", "2", "3", "4", "5", "click", "", "song", "t", "20180101", "7", "1", "0"]
    bad = ["x", *good[1:]]
    path = lines(spark, tmp_path / "l", "@cc@".join(good), "@cc@".join(bad))
    got = X.read_delimited(spark, path, X.LABELLED_DELIMITER, X.LABELLED_SCHEMA).collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, 4, 5, "click", "", "song", "t", "20180101", 7, 1, 0)]


def test_a_missing_value_keeps_its_field(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    sinks.write_delimited(rows, str(tmp_path / "d"), "@cc@")
    assert spark.read.text(str(tmp_path / "d")).first()[0] == "1@cc@None@cc@x"


def test_impressions(spark, tmp_path):
    path = lines(spark, tmp_path / "i", "u1 3,4,5 x y 1,0,1", "u2 3 x y", "u3 1,2 x y 1")
    assert [tuple(r) for r in X.read_impressions(spark, path).collect()] == [("u1", 3, 1), ("u1", 4, 0), ("u1", 5, 1)]


def test_id_map(spark, tmp_path):
    path = lines(spark, tmp_path / "m", "(11, 0)", "('12', 9999)", "(13L, 5)", "(14, 10000)", "print(1)", "(u, 1)")
    got = X.read_id_map(spark, path).collect()
    assert sorted(tuple(r) for r in got) == [(11, 0), (12, 9999), (13, 5)]


def test_ranked_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "sentence string, prob double")
    sinks.write_ranked_csv(rows.repartition(3), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert [line for line in text.splitlines() if not line.startswith("sentence")] == ["b,0.9", "c,0.5", "a,0.1"]


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0, 2.0])], "id long, word string, vec array<float>")
    sinks.save_vectors(rows, str(tmp_path / "v"))
    assert tuple(sinks.load_vectors(spark, str(tmp_path / "v")).first()) == (1, "a", [1.0, 2.0])


def test_routed_parquet(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "media_type int, comment string")
    sinks.write_routed(rows, str(tmp_path / "r"), "media_type")
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["media_type=1", "media_type=2"]


def test_the_shared_folder_is_the_one_the_session_names(spark):
    class Conf(dict):
        pass

    class Other:
        def __init__(self, **conf):
            self.conf = Conf(conf)

    assert session.work_dir(Other(**{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    assert session.work_dir(Other(**{"spark.sql.warehouse.dir": "hdfs://x/warehouse/"})) == "hdfs://x/warehouse/_work"
    rows = session.materialise(spark.range(5))
    assert rows.count() == 5
