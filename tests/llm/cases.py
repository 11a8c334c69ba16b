"""Documents with every awkward case, shared by the tests of the operators."""

LONG = " ".join(f"word{i % 997} and" for i in range(30_000))
PLAIN = "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge and laugh. "

ROWS = [
    (1, PLAIN * 2 + "\nEnd of one."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "é" * 500 + " ünïcode 😘 text\x0bwith\x0codd spaces here  twice"),
    (7, PLAIN * 2 + "\nEnd of one."),
    (7, PLAIN * 2 + "\nEnd of one."),
    (None, "no id at all, but some words to read here."),
    (9, "x" * 100_000),
    (-3, "one"),
]

# Extra columns with names that operators use themselves.
EXTRA = ["bits", "kept", "length", "start", "place", "hash"]


def frame(spark, rows=None, extra=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string")
    for i, name in enumerate(extra):
        df = df.withColumn(name, F.lit(i))
    return df.repartition(3)
