"""Encoding, records and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echolane.llm import packing, records
from echolane.llm.tokens import Encoder, load_vocabulary
from echolane.session import fresh_path

from .cases import EXTRA, ROWS, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = load_vocabulary(PATH)


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'é1.,!?;_$ \n\t\x1c 😘", max_size=40), max_size=5))
def test_parts_give_the_same_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(map(int, ids)) for ids in Encoder(VOCABULARY).encode(texts)] == want


def test_marks_are_what_the_plain_call_makes_of_them(plain):
    text = "stop <|endoftext|> go"
    assert Encoder(VOCABULARY).encode([text])[0].tolist() == plain(text) == [11338, 220, 50256, 467]


def test_given_documents_are_encoded_as_by_the_plain_call(spark, plain):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] or "" for r in rows]
    assert [ids.tolist() for ids in Encoder(VOCABULARY).encode(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 60_000, "#$" * 30_000, " \t" * 30_000 + "x", (" " * 999 + "é") * 60])
def test_long_runs(plain, text):
    assert Encoder(VOCABULARY).encode([text])[0].tolist() == plain(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(spark, plain):
    path = fresh_path(spark, "records")
    records.write_records(frame(spark, extra=EXTRA), path, VOCABULARY, end_id=2)
    rows = records.with_starts(records.read_records(spark, path), records.read_index(spark, path)).collect()
    key = lambda i: (i is not None, i or 0)
    want = sorted(((i, plain(t) + [2]) for i, t in ROWS), key=lambda r: key(r[0]))
    got = sorted(rows, key=lambda r: (r["start"]))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    start = 0
    for row, (_, ids) in zip(got, want):
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        assert np.frombuffer(row["tokens"], "<u4").tolist() == ids
        start += len(ids)


def test_index_cuts_the_same_records(spark):
    path = fresh_path(spark, "records")
    records.write_records(frame(spark), path, VOCABULARY, end_id=2)
    rows = records.read_shuffled(spark, path, seed=3).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ROWS)
    for row in rows:
        doc_id, _, end = records.parse(bytes(row["frame"]))
        assert doc_id == row["doc_id"] and end == len(row["frame"])


def test_damage_is_found():
    data = records.frame(5, np.array([1, 2, 3], "<u2")) + records.END_BYTE
    assert records.parse(data)[0] == 5
    for place in range(len(data)):
        broken = bytearray(data)
        broken[place] ^= 4
        with pytest.raises(records.BadRecord):
            records.parse(bytes(broken))


def test_records_of_nothing(spark):
    path = fresh_path(spark, "records")
    records.write_records(frame(spark, rows=[]), path, VOCABULARY, end_id=2)
    assert records.with_starts(records.read_records(spark, path), records.read_index(spark, path)).count() == 0


def check_packing(rows, capacity):
    places = defaultdict(list)
    for row in rows:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_and_places(spark, plain):
    rows = packing.pack_documents(frame(spark, extra=EXTRA), VOCABULARY, end_id=0, capacity=64).collect()
    check_packing(rows, 64)
    pieces = defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append((row["piece"], row["start"], row["length"], row["ids_crc32"]))
    want = defaultdict(list)
    for doc_id, text in ROWS:
        ids, start = plain(text) + [0], 0
        for piece, length in enumerate(packing.piece_lengths(len(ids), 64)):
            want[doc_id].append((piece, start, length, crc(ids[start : start + length])))
            start += length
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_places_everything_once(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.Plan(counts, 30)
    rows = defaultdict(list)
    for length, n in counts.items():
        runs = sorted(plan.entries[length])
        for number in range(n):
            first, row, per_row, offset = max(run for run in runs if run[0] <= number)
            rows[row + (number - first) // per_row].append({"offset": offset + (number - first) % per_row * length, "length": length})
    check_packing([r | {"sequence_id": k} for k, found in rows.items() for r in found], 30)
    large = [x for x in lengths if 3 * x > 30]
    assert all(sum(3 * r["length"] > 30 for r in found) <= 2 for found in rows.values())
    # First fit by falling length is the usual yardstick.
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = next((i for i, used in enumerate(bins) if used + x <= 30), None)
        if fit is None:
            bins.append(x)
        else:
            bins[fit] += x
    assert len(rows) <= len(bins) * 11 / 9 + 1
    assert large or len(rows) <= len(bins) + 1


def test_packing_nothing(spark):
    assert packing.pack_documents(frame(spark, rows=[]), VOCABULARY, end_id=0).count() == 0


def test_many_pieces_are_tight(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.randint(1, 2048), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    packed = packing.pack(pieces).collect()
    used = check_packing(packed, 2048)
    assert len(packed) == 3000 and used <= 1.02 * sum(r[3] for r in rows) / 2048 + 1
    assert pieces.agg(F.sum("length")).first()[0] == sum(r["length"] for r in packed)
