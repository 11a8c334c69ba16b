"""The pipeline's stages on the smallest tables, and the registered queries."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from echolane.llm import decontaminate, queries, rules, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("kept", F.lit("a column of its own"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialise(stage(spark, out[-1], FOLDER), name))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_each_stage_does_its_own(spark, stages):
    docs, good, lines, apart, clean, packed = stages
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    failed = [i for i, t in texts.items() if rules.base_failed(rules.np.array([rules.statistics(t or "")]))[0]]
    assert not set(failed) & set(ids(good))
    assert ids(lines) == ids(good)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    marks = {r["doc_id"]: simhash.fingerprint(r["text"] or "", 5) for r in lines.collect()}
    left = ids(apart)
    far = lambda a, b: ((marks[a] ^ marks[b]) & (1 << 64) - 1).bit_count() > 4
    assert all(far(a, b) for a in left for b in left if a < b)
    assert all(any(not far(a, b) for b in marks if b != a) for a in set(marks) - set(left))
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    held = [b" ".join(decontaminate.words_of(r["text"])) for r in items]
    for r in apart.collect():
        words = b" " + b" ".join(decontaminate.words_of(r["text"] or "")) + b" "
        if any(b" " + item + b" " in words for item in held):
            assert r["doc_id"] not in ids(clean)


def test_all_tokens_are_packed(stages):
    *_, clean, packed = stages
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean.collect()}
    got = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(queries.ORACLE) <= set(names)
