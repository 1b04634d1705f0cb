"""Operator 4: token ids of whole documents in checksummed, range-coded frames.

Documents are range-sorted by doc_id with one exchange; each task encodes its run and writes
frames of whole documents.  A frame holds (all numbers little-endian)

    "TLF3", documents u32, ids u64, size of the table u32,
    table (zlib): doc_id i64 of each document, ids u32 of each, null flag u8 of each,
    the ids of all its documents in blocks of `coder`.

Frames are rows (part, frame, n_ids, data) of Parquet files, so any file system that Spark knows
can hold them and a lost task leaves no half-written frame.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import coder
from .common import slices, work_folder
from .pieces import pieces

FRAME_IDS = 2_000_000
FRAMES = "part int, frame int, n_docs long, n_ids long, data binary"
_HEAD = struct.Struct("<4sIQI")


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + null.tobytes(), 1)
    return _HEAD.pack(b"TLF3", len(doc_ids), len(ids), len(table)) + table + coder.encode(ids)


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a frame; raises ValueError where it is damaged."""
    magic, n, n_ids, size = _HEAD.unpack_from(data)
    if magic != b"TLF3":
        raise ValueError("not a frame")
    table = zlib.decompress(data[_HEAD.size : _HEAD.size + size])
    doc_ids, lengths, null = np.frombuffer(table, "<i8", n), np.frombuffer(table, "<u4", n, 8 * n), np.frombuffer(table, np.uint8, n, 12 * n)
    ids = coder.decode(data[_HEAD.size + size :])
    if len(ids) != n_ids or lengths.sum(dtype=np.int64) != n_ids:
        raise ValueError("a frame lacks ids")
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], lengths, ids


def _framed(path: str, end: int | None):
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches):
        p, part, frame = pieces(path), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, total = [], [], [], 0

        def row():
            data = pack(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "frame", "n_docs", "n_ids", "data"])

        for batch in batches:
            for cut in slices(batch, "text"):
                for d, ids in zip(cut.column(0).to_pylist(), p.ids([t or "" for t in cut.column(1).to_pylist()]), strict=True):
                    ids += tail
                    doc_ids.append(d)
                    lengths.append(len(ids) // 4)
                    held.append(ids)
                    total += len(ids) // 4
                    if total >= FRAME_IDS:
                        yield row()
                        doc_ids, lengths, held, total, frame = [], [], [], 0, frame + 1
        if doc_ids:
            yield row()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int | None = 0) -> None:
    """Encodes all texts (null: empty), appends the id ``end`` to each and writes frames in ascending doc_id order.

    docs needs doc_id and text; other columns are ignored.  Null ids come first; rows with one id
    are ordered by their text.  An empty table writes no frame.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(*order).mapInArrow(_framed(tokenizer, end), FRAMES).write.parquet(path)


def _read(batches):
    for batch in batches:
        for part, frame, data in zip(*(batch.column(c).to_pylist() for c in ("part", "frame", "data")), strict=True):
            doc_ids, lengths, ids = unpack(data)
            edge = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([frame] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(edge[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "frame", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Decodes every frame and returns for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the totals of the parts, one row for each written partition, meet in one place to give the starts.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    read = frames.select("part", "frame", "data").mapInArrow(_read, "part int, frame int, doc_id long, local long, n_tokens long, ids_crc32 long")
    slim = frames.select("part", "frame", "n_ids")
    earlier = lambda *by: F.coalesce(F.sum("n_ids").over((W.partitionBy(*by[:-1]) if by[:-1] else W).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = slim.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier("part").alias("part_start"))
    starts = slim.select("part", "frame", earlier("part", "frame").alias("frame_start")).join(F.broadcast(parts), "part")
    return read.join(starts, ["part", "frame"]).select("doc_id", (F.col("part_start") + F.col("frame_start") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents back: doc_id, ids."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                doc_ids, lengths, ids = unpack(data)
                edge = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return spark.read.schema(FRAMES).parquet(path).select("data").mapInArrow(run, "doc_id long, ids array<long>")


def token_index(docs: DataFrame, tokenizer: str, path: str | None = None, end: int | None = 0) -> DataFrame:
    """Writes the frames (to a new folder beside the stored steps if none is given) and reads them back."""
    path = path or f"{work_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, end)
    return read_index(docs.sparkSession, path)
