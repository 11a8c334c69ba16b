import random
from collections import Counter

from pyspark.sql import functions as F

from echolane.operators import order as O


def test_index_is_contiguous_and_in_order(spark):
    values = [random.Random(3).randrange(1000) for _ in range(5000)] + [7] * 2500
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(16)
    got = O.with_index(rows, [F.col("v").desc(), F.col("i").asc()], "at", start=1).collect()
    want = sorted(range(len(values)), key=lambda i: (-values[i], i))
    assert [r["i"] for r in sorted(got, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in got) == list(range(1, len(values) + 1))


def test_running_total(spark):
    values = [random.Random(4).randrange(50) for _ in range(3000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long").repartition(16)
    got = {r["i"]: r["before"] for r in O.running_total(rows, [F.col("i").asc()], "v", "before").collect()}
    assert got == {i: sum(values[:i]) for i in range(len(values))}


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "i int, v long")
    assert O.with_index(empty, [F.col("i").asc()]).count() == 0
    assert O.running_total(empty, [F.col("i").asc()], "v", "before").count() == 0


def test_batches(spark):
    rows = spark.range(1000).withColumnRenamed("id", "i")
    kept = O.batch_index(rows, [F.col("i").asc()], 300).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in kept} == {0: 300, 1: 300, 2: 300, 3: 100}
    cut = O.batch_index(rows, [F.col("i").asc()], 300, drop_tail=True).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in cut} == {0: 300, 1: 300, 2: 300}


def test_labels(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "u string")
    assert {r["u"]: r["label"] for r in O.label_encode(rows, "u").collect()} == {"a": 0, "b": 1, "c": 2}


def test_top_n_is_cut_before_the_shuffle(spark, capsys):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = O.top_n(rows, ["g"], [F.col("id").desc()], 2)
    assert {(r["g"], r["id"]) for r in top.collect()} == {(0, 999), (0, 996), (1, 997), (1, 994), (2, 998), (2, 995)}
    top.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_heavy_rows_by_a_histogram(spark):
    rows = spark.createDataFrame([(n,) for n in [1] * 500 + [2] * 90 + [7] * 9 + [1000, 1001, 5000]], "n long")
    for most, want in ((0, None), (1, 5000), (2, 5000), (3, 1000), (12, 7), (101, 7), (102, 2), (700, 1)):
        assert O.heavy_from(rows, "n", most) == want
    assert O.heavy_from(rows.limit(0), "n", 5) is None


def test_a_hot_key_is_dealt_out(spark):
    """One key in a third of all rows and as many rows without one, with all skew handling off."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 97}") for i in range(6000)]
    left = spark.createDataFrame(rows, "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k5", 2), ("k5", 3), (None, 4)], "k string, v int")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        met = O.join_split(left, right, ["k"]).withColumn("task", F.spark_partition_id())
        got = met.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by_key = {"hot": [1], "k5": [2, 3]}
    assert sorted((r["i"], str(r["v"])) for r in got) == sorted((i, str(v)) for i, k in rows for v in by_key.get(k, [None]))
    tasks = Counter(r["task"] for r in got)
    assert len(tasks) == 8 and max(tasks.values()) < 2 * len(got) / 8
