"""Token sequences as length-delimited binary records, with a separate offset index.

One file holds one range of ids. Its records follow each other as

    length   4 bytes   bytes of the payload, little-endian
    check    4 bytes   masked CRC-32 of the four length bytes
    payload            document id (8 bytes, signed), flags (1 byte), then the token ids
    check    4 bytes   masked CRC-32 of the payload
    end      1 byte    0x0A

Flag 1 marks four bytes per id (else two), flag 2 a document without an id. The mask rotates a
checksum by 15 bits and adds a constant, so that a checksum of data that hold checksums stays
useful. ``index/`` holds ``file, place, doc_id, offset, length, n_tokens`` for every record (place:
the file's number in id order), from which readers pick records in any order.

Spark's own text writer puts the frames into files, so commits, retries and remote stores work as
for any other table; the end byte is its line separator and means nothing to a reader.

Defined cases: a missing text is an empty one and still ends with the end id; rows without an id
come first; rows that share an id are ordered by their text's hash, equal ones follow each other;
an empty table writes no record; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, text_rows
from .tokens import TEXTS, Encoder

# Fixed values of the format.
MASK_DELTA, END_BYTE, WIDE, NO_ID = 0xA282EAD8, b"\n", 1, 2
_HEAD, _PAYLOAD = "<II", "<qB"
_HEAD_SIZE, _PAYLOAD_SIZE = struct.calcsize(_HEAD), struct.calcsize(_PAYLOAD)

# Records per file at most, so that a file stays far below what one task can read.
FILE_RECORDS = 20_000

INDEX_SCHEMA = "file string, doc_id long, offset long, length long, n_tokens long"


class BadRecord(ValueError):
    """A record whose checksums or lengths don't hold."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record, without the end byte."""
    flags = (WIDE if ids.dtype.itemsize == 4 else 0) | (NO_ID if doc_id is None else 0)
    payload = struct.pack(_PAYLOAD, doc_id or 0, flags) + ids.tobytes()
    length = struct.pack("<I", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def parse(data: bytes, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """Document id, token ids and the next record's offset; raises ``BadRecord``."""
    if offset + _HEAD_SIZE > len(data):
        raise BadRecord(f"cut off at {offset}")
    length, check = struct.unpack_from(_HEAD, data, offset)
    begin = offset + _HEAD_SIZE
    end = begin + length
    if masked_crc(data[offset : offset + 4]) != check or end + 5 > len(data):
        raise BadRecord(f"bad length at {offset}")
    payload = data[begin:end]
    if struct.unpack_from("<I", data, end)[0] != masked_crc(payload) or data[end + 4 : end + 5] != END_BYTE:
        raise BadRecord(f"bad payload at {offset}")
    doc_id, flags = struct.unpack_from(_PAYLOAD, payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & WIDE else "<u2", offset=_PAYLOAD_SIZE)
    return (None if flags & NO_ID else doc_id), ids, end + 5


def heads(data: bytes | memoryview) -> Iterator[tuple[int | None, int, int, int]]:
    """Document id, number of ids, offset and size of every record, from its head alone."""
    offset = 0
    while offset < len(data):
        if offset + _HEAD_SIZE + _PAYLOAD_SIZE > len(data):
            raise BadRecord(f"cut off at {offset}")
        length, check, doc_id, flags = struct.unpack_from(_HEAD + _PAYLOAD[1:], data, offset)
        size = _HEAD_SIZE + length + 5
        if masked_crc(data[offset : offset + 4]) != check or offset + size > len(data):
            raise BadRecord(f"bad length at {offset}")
        yield None if flags & NO_ID else doc_id, (length - _PAYLOAD_SIZE) // (4 if flags & WIDE else 2), offset, size
        offset += size


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.read.format("binaryFile").schema(schema).load(f"{path}/data").where("length > 0").select(name, "content")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
            data, offset, rows = memoryview(content.as_buffer()), 0, []
            while offset < len(data):
                doc_id, ids, after = parse(data, offset)
                rows.append((doc_id, ids, offset, after - offset))
                offset = after
            yield file, rows


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode ``doc_id, text``, append ``end_id``, write records in ascending id order and their index."""
    spark = docs.sparkSession
    rows = text_rows(docs)
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(vocabulary)
        last = np.array([end_id], dtype=encoder.dtype if end_id < 1 << 8 * encoder.dtype.itemsize else "<u4")
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                tokens = encoder.encode(part.column("text").to_pylist())
                yield {"frame": [frame(i, np.concatenate([t, last])) for i, t in zip(part.column("doc_id").to_pylist(), tokens)]}

    frames = map_batches(rows, work, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", END_BYTE.decode()).option("maxRecordsPerFile", FILE_RECORDS).text(f"{path}/data")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                ids, sizes, offsets, lengths = zip(*heads(memoryview(content.as_buffer())))
                yield {"file": [file] * len(ids), "doc_id": ids, "offset": offsets, "length": lengths, "n_tokens": sizes}

    entries = map_batches(_files(spark, path), index, INDEX_SCHEMA)
    # Names are part-<task>-<job>-c<file>, and tasks hold ascending ranges.
    place = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("long") * 1_000_000 + F.regexp_extract("file", r"-c(\d+)", 1).cast("long")
    entries.select("file", place.alias("place"), "doc_id", "offset", "length", "n_tokens").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    schema = "file string, place long, doc_id long, offset long, length long, n_tokens long"
    return spark.read.schema(schema).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, doc_id, n_tokens, tokens, ids_crc32`` of every record; tokens are 4-byte ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for file, found in _records(batches):
            for begin in range(0, len(found), 2_000):
                ids, tokens, offsets, _ = zip(*found[begin : begin + 2_000])
                wide = [t.astype("<u4").tobytes() for t in tokens]
                yield {
                    "file": [file] * len(ids),
                    "offset": offsets,
                    "doc_id": ids,
                    "n_tokens": [len(t) for t in tokens],
                    "tokens": wide,
                    "ids_crc32": [zlib.crc32(w) for w in wide],
                }

    schema = "file string, offset long, doc_id long, n_tokens long, tokens binary, ids_crc32 long"
    return map_batches(_files(spark, path), work, schema)


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """``order, doc_id, frame``: every record once, in an order drawn from the index by ``seed``.

    The records are cut out of the files by the index's offsets, without looking at the frames.
    """
    index = read_index(spark, path).select("file", "doc_id", "offset", "length")
    picked = index.join(_files(spark, path), "file")
    cut = F.expr("substring(content, int(offset) + 1, int(length))").alias("frame")
    order = F.xxhash64(F.lit(seed), "file", "offset").alias("order")
    return picked.select(order, "doc_id", cut).repartitionByRange("order").sortWithinPartitions("order")


def with_starts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``start``, the ids in all records before, to rows with ``file, offset``.

    Ids are summed per file; only one figure per file of up to ``FILE_RECORDS`` records meets the
    others in the window, and inside a file a window of its own counts.
    """
    from pyspark.sql import Window

    files = index.groupBy("file", "place").agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(Window.orderBy("place")) - F.col("sum")
    files = files.select("file", before.alias("before"))
    earlier = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    places = index.select("file", "offset", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("inside"))
    places = places.join(files, "file").select("file", "offset", (F.col("before") + F.col("inside")).alias("start"))
    return rows.join(places, ["file", "offset"])
