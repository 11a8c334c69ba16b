"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import alignment, byte_cnn, ctw, decontaminate, line_chunks, packing, personal_data, preference, records, rules, runs, secrets, simhash
from .common import documents, read_table
from .tokens import load_vocabulary


def vocabulary() -> str:
    import public_tokenizers

    return load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def token_records(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "records")
    records.write_records(documents(spark, folder), path, vocabulary(), end_id=2)
    rows = records.with_starts(records.read_records(spark, path).drop("tokens"), records.read_index(spark, path))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset")


def packed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), vocabulary(), end_id=0)


def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, folder), read_table(spark, folder, "benchmark"))


def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, folder))


def personal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find_personal_data(documents(spark, folder))


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.repeated_passages(documents(spark, folder))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(documents(spark, folder), shingle=4)


def context_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score(documents(spark, folder))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return rules.judge(docs, rules.fit(docs, read_table(spark, folder, "labels")))


def preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return preference.format_pairs(preference.reply_pairs(read_table(spark, folder, "conversations")))


def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = alignment.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align_documents(documents(spark, folder), vocabulary(), model)


def byte_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return byte_cnn.score(docs, byte_cnn.fit(docs, read_table(spark, folder, "labels")))


def word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digest(runs.periodic_runs(documents(spark, folder), runs.repeated_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_leaks": benchmark_leaks,
    "op2_secret_spans": secret_spans,
    "op3_token_records": token_records,
    "op4_packed_pieces": packed_pieces,
    "op5_personal_spans": personal_spans,
    "op6_repeated_passages": repeated_passages,
    "op7_near_copies": near_copies,
    "op8_context_tree_scores": context_tree_scores,
    "op9_quality_rules": quality_rules,
    "op10_preference_pairs": preference_pairs,
    "op11_token_alignment": token_alignment,
    "op12_byte_quality": byte_quality,
    "op13_word_runs": word_runs,
}

ORACLE: dict[str, str] = {
    "op10_preference_pairs": preference.ORACLE_SQL,
}
