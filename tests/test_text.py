import pytest
from pyspark.sql import functions as F

from echolane.functions import text as T
from echolane.operators import corpus as C

FULL = [
    ("NICE song!!! 😘😘 call 1234567890123", ["nice", "song", "😘", "😘", "call", "123"]),
    ("it's ' so ' good", ["it's", "so", "'", "good"]),
    ("wow", None),
    ("wow '", ["wow"]),
    ("look >>> here", None),
    ("ID=77 hello there", None),
    ("a-b_c/d", ["a", "b", "c", "d"]),
    ("very👍🏽nice", ["very", "👍🏽", "nice"]),
    ("two '' marks", ["two", "marks"]),
    ("love ❤️ it", ["love", "❤", "️", "it"]),
    ("a　b。c", ["a", "b", "c"]),
    ("both ' and '' marks", ["both", "and", "''", "marks"]),
    ("one • dot", None),
    ("", None),
    ("   ", None),
    ("a\x1cb\xa0c d", ["a", "b", "c", "d"]),
]

TAGGED = [
    ("x <b>bold</b> y", "keep", ["x", "y"]),
    ("semi;colon = [kept] | here", "keep", ["semi;colon", "=", "[kept]", "|", "here"]),
    ("it ' is ' so", "lone", ["it", "is", "'", "so"]),
    ("it '' is", "lone", ["it", "''", "is"]),
    ("id=1 stays >>> too", "keep", ["id=1", "stays", ">>>", "too"]),
    ("1234567890 digits", "keep", ["1234567890", "digits"]),
]


def test_full_profile(spark):
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(FULL)], "k int, line string")
    got = {r["k"]: r["tokens"] for r in C.tokenize(rows).collect()}
    assert got == {i: words for i, (_, words) in enumerate(FULL) if words is not None}


@pytest.mark.parametrize("line, apostrophes, words", TAGGED)
def test_tags_profile(spark, line, apostrophes, words):
    rows = spark.createDataFrame([(line,)], "line string")
    assert C.tokenize(rows, profile="tags", apostrophes=apostrophes).first()["tokens"] == words


def test_null_line_and_unknown_profile(spark):
    rows = spark.createDataFrame([(None,), ("two words",)], "line string")
    assert [r["tokens"] for r in C.tokenize(rows).collect()] == [["two", "words"]]
    with pytest.raises(ValueError):
        C.tokenize(rows, profile="other")


def test_marks(spark):
    rows = spark.createDataFrame([(["a", "b"],)], "tokens array<string>")
    assert rows.select(T.with_marks(F.col("tokens"))).first()[0] == ["$", "a", "b", "!"]


def test_lines_are_numbered(spark):
    rows = spark.createDataFrame([(1, "x\n\ny")], "k int, text string")
    assert [tuple(r) for r in C.split_lines(rows, "k", "text").collect()] == [(1, 0, "x"), (1, 1, ""), (1, 2, "y")]


def test_row_wise_operators_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "so nice song"), (2, "wow")], "k int, line string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, line string").parquet(str(tmp_path / "in"))
    query = C.tokenize(stream).writeStream.format("memory").queryName("words").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["tokens"] for r in spark.table("words").collect()] == [["so", "nice", "song"]]
