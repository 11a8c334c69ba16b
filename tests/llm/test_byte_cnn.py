import zlib

import numpy as np
import pytest

from checks.inputs import read_table
from echolane.llm import byte_cnn as B


def small(seed=0, filters=3):
    draw = np.random.default_rng(seed)
    f = lambda *shape: draw.normal(0, 0.4, shape).astype(np.float32)
    return B.Net(f(B.WIDTH, 256, filters), f(filters), f(filters), f(filters), f(1))


def plain(net, text):
    """One text's probability, place by place."""
    halves = -(-(len(text) + B.WIDTH - 1) // B.HALF)
    data = bytes(B.WIDTH - 1) + text + bytes(halves * B.HALF - len(text))
    answer = [[sum(float(net.table[w, data[i + w], f]) for w in range(B.WIDTH)) for f in range(len(net.shift))] for i in range(halves * B.HALF)]
    chunks = [answer[i * B.HALF : (i + 2) * B.HALF] for i in range(max(1, halves - 1))]
    tops = np.array([[max(0.0, max(p[f] for p in c) + float(net.shift[f])) for f in range(len(net.shift))] for c in chunks])
    return 1 / (1 + np.exp(-(tops.mean(axis=0) @ net.mean + tops.max(axis=0) @ net.most + net.bias[0])))


TEXTS = [b"", b"a", b"x" * 121, b"y" * 122, bytes(range(256)) * 3, "é ! Ü\n".encode() * 90, b"The end." * 16]


def test_whole_texts_place_by_place():
    net = small()
    got = B.probabilities(net, TEXTS)
    assert got == pytest.approx([plain(net, t) for t in TEXTS], abs=1e-5)
    # What stands beside a text, and where work is cut, changes nothing.
    assert [B.probabilities(net, [t])[0] for t in TEXTS] == pytest.approx(got, abs=1e-6)


def test_a_long_text_is_scored_to_its_end(monkeypatch):
    net = small(1)
    text = b"plain words " * 20_000
    assert B.probabilities(net, [text + b"#$%&|<>!"])[0] != B.probabilities(net, [text])[0]
    whole = B.probabilities(net, [text])[0]
    monkeypatch.setattr(B, "PLACES", B.HALF)
    assert B.probabilities(net, [text])[0] == pytest.approx(whole, abs=1e-6)


def test_gradients_by_differences():
    net, labels = small(2), np.array([1, 0, 1, 0, 1, 0, 1], bool)
    net = B.Net(*[p.astype(np.float64) for p in net.parts()])
    _, grads = B.gradients(net, TEXTS, labels)
    draw = np.random.default_rng(0)
    for value, grad in zip(net.parts(), grads):
        busy = np.flatnonzero(grad.ravel())
        for at in draw.choice(busy, min(12, len(busy)), replace=False):
            kept, sides = value.ravel()[at], []
            for change in (1e-5, -1e-5):
                value.ravel()[at] = kept + change
                sides.append(B.gradients(net, TEXTS, labels)[0])
            value.ravel()[at] = kept
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grad.ravel()[at], rel=1e-2, abs=1e-6)


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return read_table(spark, folder, "documents"), read_table(spark, folder, "labels")


def test_held_out_rows_are_told_apart(spark, tables):
    docs, labels = tables
    net = B.fit(docs, labels)
    rows = {r["doc_id"]: r for r in B.score(docs, net).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    known = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in rows]
    unseen = [(r["predicted"], q) for r, q in known if r["held_out"]]
    assert len(unseen) > 60 and sum(p == q for p, q in unseen) / len(unseen) > 0.93
    bad = [p for p, q in unseen if q == 0]
    assert sum(p == 0 for p in bad) / len(bad) > 0.7


def test_no_held_out_label_is_read(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(B.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = B.training_sample(docs, labels), B.training_sample(docs, turned)
    assert a[0] == b[0] and (a[1] == b[1]).all() and len(a[0]) > 200
    assert len(B.training_sample(docs, labels, rows=100)[0]) < 160


def test_defined_cases(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (2, ""), (3, "b " * 400)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "1 AS score", "'x' AS good", "0 AS draw")
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id int, quality int, toxic int")
    rows = B.score(docs, B.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert len({r["score"] for r in rows}) == 1 and rows[0]["score"] > 0.99
    assert {r["score"] for r in B.score(docs, B.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert B.score(docs.limit(0), small()).count() == 0
