"""Operator 2: token counts by distinct pre-token.

A task splits its texts into pre-tokens and keeps, for a chunk of texts, one dictionary and each
text's frequencies by dictionary number.  The dictionaries go, dealt by hash, to tasks that count
the pieces of each distinct pre-token once; the counts return to their chunks, where frequencies
times counts are summed.  No ids of a text are ever made.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .pieces import pieces

CHUNK_BYTES, CHUNK_TOKENS, CHUNK_DOCS = 32 << 20, 1 << 20, 200_000
DEALS = 4096
GROUP_TOKENS = 500_000
PARTS = "chunk long, doc_id long, n_bytes long, ids binary, times binary, deal int, first long, tokens array<string>"


def _narrow(x: np.ndarray) -> bytes:
    """The numbers in as few bytes each as the largest needs; the first byte says how many."""
    top = int(x.max(initial=0))
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


class _Chunk:
    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.dictionary: dict[str, int] = {}
        self.docs: list[tuple] = []

    def add(self, doc_id, text: str, n_bytes: int, tokens: list[str]) -> None:
        put = self.dictionary.setdefault
        ids = np.fromiter((put(t, len(self.dictionary)) for t in tokens), np.uint32, len(tokens))
        self.docs.append((doc_id, n_bytes, *np.unique(ids, return_counts=True)))
        self.bytes += n_bytes

    def full(self) -> bool:
        return self.bytes >= CHUNK_BYTES or len(self.dictionary) >= CHUNK_TOKENS or len(self.docs) >= CHUNK_DOCS

    def rows(self):
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("times", pa.binary()), ("deal", pa.int32()), ("first", pa.int64()), ("tokens", pa.list_(pa.string()))])
        tokens = list(self.dictionary)
        deal = np.fromiter((zlib.crc32(t.encode()) % DEALS for t in tokens), np.int64, len(tokens))
        order = np.argsort(deal, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        edge = np.searchsorted(deal[order], np.arange(DEALS + 1))
        full = np.flatnonzero(np.diff(edge))
        by_deal = [[tokens[i] for i in order[edge[d] : edge[d + 1]]] for d in full]
        none = lambda n, kind: pa.nulls(n, kind)
        n = len(full)
        yield pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary()), pa.array(full, pa.int32()), pa.array(edge[full], pa.int64()), pa.array(by_deal, pa.list_(pa.string()))], schema=schema)
        for i in range(0, len(self.docs), 5000):
            part = self.docs[i : i + 5000]
            ids, times = [], []
            for _, _, which, count in part:
                which = place[which]
                turn = np.argsort(which)
                ids.append(_narrow(np.diff(which[turn], prepend=np.uint32(0))))
                times.append(_narrow(count[turn]))
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.list_(pa.string()))], schema=schema)


def _chunked(path: str):
    def run(batches):
        p = pieces(path)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                chunk.add(doc_id, text, len(text.encode()), p.pre_tokens(text))
                if chunk.full():
                    yield from chunk.rows()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.docs:
            yield from chunk.rows()

    return run


def _counted(path: str):
    def run(key, table):
        p = pieces(path)
        lists = table.column("tokens").to_pylist()
        distinct = list({t for x in lists for t in x})
        count = dict(zip(distinct, p.counts(distinct), strict=True))
        made = [np.fromiter((count[t] for t in x), np.uint32, len(x)).tobytes() for x in lists]
        return pa.table({"chunk": table.column("chunk"), "first": table.column("first"), "made": pa.array(made, pa.binary())})

    return run


def _summed(key, docs, counts):
    order = np.argsort(counts.column("first").to_numpy())
    made = counts.column("made").to_pylist()
    count = np.frombuffer(b"".join(made[i] for i in order), np.uint32).astype(np.int64)
    total = []
    for ids, times in zip(docs.column("ids").to_pylist(), docs.column("times").to_pylist(), strict=True):
        which = np.cumsum(_wide(ids))
        total.append(int(count[which] @ _wide(times)) if len(which) else 0)
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())})


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of each whole text, as the library gives them without begin, end or added special tokens.

    docs needs doc_id and text; other columns are ignored.  Returns one row for each input row:
    doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).  Null and empty texts have 0.
    Null and repeated ids are kept as they are.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = stored(docs.mapInArrow(_chunked(path), PARTS), "chunks")
    total = parts.agg(F.sum(F.size("tokens")).cast("long")).first()[0] or 0
    groups = min(DEALS, max(8, -(-total // GROUP_TOKENS)))
    dictionaries = parts.where("deal is not null").select(F.pmod("deal", F.lit(groups)).alias("group"), "chunk", "first", "tokens")
    counts = dictionaries.groupBy("group").applyInArrow(_counted(path), "chunk long, first long, made binary")
    frequencies = parts.where("deal is null").select("chunk", "doc_id", "n_bytes", "ids", "times")
    sums = frequencies.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
