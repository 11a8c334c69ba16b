import hashlib
import random
import zlib

import numpy as np
import pytest

from echolane.llm import runs as R


def brute(words):
    """All runs by comparing every word at every lag."""
    n, out = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q):
                part = words[i : i + length]
                if all(any(part[x] != part[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def planted(draw, words):
    out = [draw.choice(words) for _ in range(draw.randrange(0, 60))]
    for _ in range(draw.randrange(0, 4)):
        unit = [draw.choice(words) for _ in range(draw.choice([1, 2, 3, 5, 8, 9, 11, 12, 13, 16, 17, 24, 25, 31, 33, 48, 50]))]
        out += unit * draw.randrange(2, 6) + unit[: draw.randrange(len(unit))]
        out += [draw.choice(words) for _ in range(draw.randrange(0, 30))]
    return out


@pytest.mark.parametrize("letters", [2, 3, 40])
def test_all_runs_of_many_texts(letters):
    draw = random.Random(letters)
    texts = [planted(draw, range(letters)) for _ in range(150)] + [[], [1] * 23, [1] * 24]
    found = R.find_runs([np.array(t, np.int64) for t in texts])
    for text, runs in zip(texts, found):
        assert runs == brute(text)
    assert sum(map(len, found)) > 100


def test_every_period_up_to_two_hundred():
    draw = random.Random(5)
    texts = []
    for q in range(1, 201):
        unit = [draw.randrange(1000) for _ in range(q)]
        texts.append([2000, 2001] + unit * max(3, -(-24 // q)) + [2002])
    for q, runs in enumerate(R.find_runs([np.array(t, np.int64) for t in texts]), 1):
        assert any(period == q and start <= 2 and start + length >= 2 + 3 * q for start, length, period in runs)


def test_runs_of_words_that_nearly_repeat_inside_a_period():
    unit = [0, 0, 1] * 7 + [2]  # the period is 22, and 3 repeats inside it for 21 words
    text = np.array(unit * 4, np.int64)
    assert R.find_runs([text])[0] == brute(unit * 4) == [(0, 88, 22)]


def digest_row(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept)))
    if not found:
        return (doc_id, 0, None, None, None, None, *tail)
    from fractions import Fraction

    s, n, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (doc_id, len(found), s, n, q, 1000 * n // q, *tail)


def test_the_query_by_brute_force(spark):
    draw = random.Random(9)
    rows = [(1, None), (2, ""), (3, "é x " * 30), (3, "é x " * 30), (4, "a b\tc\nd " * 12), (5, "one")]
    rows += [(100 + i, " ".join(f"w{draw.randrange(500)}" for _ in range(draw.randrange(1, 300)))) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, starts string")
    got = R.run_digest(R.periodic_runs(docs, R.repeated_tail)).drop("n_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted((digest_row(i, t) for i, t in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 8


def test_ids_may_be_missing_and_tables_empty(spark):
    docs = spark.createDataFrame([(None, "a b " * 20), (None, None)], "doc_id long, text string")
    got = R.run_digest(R.periodic_runs(docs, R.repeated_tail)).collect()
    assert sorted(r["n_runs"] for r in got) == [0, 1]
    assert R.run_digest(R.periodic_runs(docs.limit(0))).count() == 0


def test_a_very_long_text(spark):
    unit = [f"u{i}" for i in range(7001)]
    words = [f"x{i}" for i in range(5000)] + unit * 12 + [f"y{i}" for i in range(5000)]
    row = R.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row["starts"], row["lengths"], row["periods"]) == ([5000], [12 * 7001], [7001])
    assert len(row["collapsed"].split()) == 17001
