"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from ..sources.tables import read_table

__all__ = ["SPACES", "digest", "discard", "documents", "lower_ascii", "map_batches", "materialise", "read_table", "text_rows", "worker_store"]

# The white space that ends a word.
SPACES = " \t\n\r\x0b\x0c"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def text_rows(docs: DataFrame) -> DataFrame:
    """Only ``doc_id, text``; a missing text counts as an empty one, a missing id stays null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """Arrow batches in, column dicts out, of sequences or Arrow arrays; ``schema`` is a DDL string."""
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32()}
    target = pa.schema([(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            arrays = [columns[field.name] for field in target]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, target)], schema=target)

    return df.mapInArrow(run, schema)


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with only A-Z made lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def digest(parts: list[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that later tasks find what earlier ones built.

    Only for things that any task can rebuild; functions travel by value and have no module state.
    """
    holder = sys.modules.setdefault("_echolane_worker", types.ModuleType("_echolane_worker"))
    return vars(holder).setdefault(name, {})
