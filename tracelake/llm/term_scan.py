"""Operator 12: ranked lexical search by scanning texts with an Aho-Corasick automaton.

There is no index of the documents.  The distinct terms of a block of items become one automaton; each pattern stands
between guards (one space either side), so it is found only as a whole term.  A text is brought to the same form (A-Z
folded, every other ASCII byte that no term holds made a space), as bytes: UTF-8 never holds an ASCII byte inside a character.
The automaton, and for each term the items that hold it, go to the tasks as a broadcast of at most about BLOCK_BYTES of terms; more
items make more blocks, each with its own scans.  The first scan counts documents, terms and document frequencies,
the second scores every text against all items of the block and keeps the best of a task for each item.
"""

from __future__ import annotations

import itertools
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import flat, ranked, slices, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES = 1 << 20  # terms of a block, each with 8 bytes more; an item stays whole, so one that is larger is a block of its own
PIECE_BYTES = 4 << 20  # text that the automaton reads at once
CELLS = 1 << 20  # scores held at once while a task adds them up
SALTS = 64  # groups in which an item's best of all tasks meet before the last rank
GUARD = 0x20
_FORM = np.array([b if b >= 128 or chr(b).isalnum() else GUARD for b in range(256)], np.uint8)
_FORM[65:91] += 32


def terms_of(text: str) -> Column:
    """Distinct terms of a text column."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))


class Block:
    """The automaton of some items' terms, and the items of each term (numbers into `ids`)."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(self.ids)}
        holders: dict[str, list[int]] = {}
        for i, term in sorted(rows, key=lambda r: (number[r[0]], r[1])):
            holders.setdefault(term, []).append(number[i])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(holders):
            self.automaton.add_word(f" {term} ".encode().decode("latin-1"), k)
        if holders:
            self.automaton.make_automaton()
        self.size = len(holders)
        self.first = np.cumsum([0, *map(len, holders.values())])
        self.items = np.fromiter(itertools.chain.from_iterable(holders.values()), np.int64)

    def counted(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the number of all its terms, and (text number, term number, occurrences) for terms of the block."""
        data, off = flat(col)
        text = np.insert(_FORM[data], off, GUARD)  # text k fills off[k] + k + 1 to off[k + 1] + k + 1
        ends = off[1:] + np.arange(1, len(off))
        begins = np.flatnonzero((text[1:] != GUARD) & (text[:-1] == GUARD)) + 1
        n = np.bincount(np.searchsorted(ends, begins), minlength=len(col))
        keys, counts = [], []
        for low, piece in self._pieces(text.tobytes()):
            hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(piece.decode("latin-1"))), np.int64).reshape(-1, 2)
            key, count = np.unique(np.searchsorted(ends, hits[:, 0] + (low - 1)) * self.size + hits[:, 1], return_counts=True)
            keys.append(key)
            counts.append(count)
        if not keys:
            return n, *np.zeros((3, 0), np.int64)
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.zeros(len(key), np.int64)
        np.add.at(times, which, np.concatenate(counts))
        return n, key // self.size, key % self.size, times

    def _pieces(self, text: bytes):
        """(place, bytes) of pieces that end and begin with the same guard, so no term is cut."""
        low = 0
        while self.size and low < len(text) - 1:
            high = len(text) - 1
            if high - low > PIECE_BYTES:
                high = text.rfind(b" ", low + 1, low + PIECE_BYTES)
                high = high if high > 0 else text.find(b" ", low + PIECE_BYTES)
            yield low, text[low : high + 1]
            low = high


def _blocks(items: DataFrame):
    """The distinct (item_id, term) in broadcasts of whole items; yields the broadcast and the block's number of terms."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of("text")).alias("term")).distinct()
    rows = stored(rows, "item-terms")
    weigh = F.sum(F.octet_length("term") + 8).cast("long")
    blocks = -(-int(rows.agg(F.coalesce(weigh, F.lit(0))).first()[0]) // BLOCK_BYTES)
    if blocks > 1:
        sizes = ranked(rows.groupBy("item_id").agg(weigh.alias("bytes")), [F.col("item_id").asc_nulls_first()], "bytes", name="item-sizes")
        number = sizes.select(F.col("item_id").alias("_item"), F.expr(f"before div {BLOCK_BYTES}").alias("block"))
        rows = stored(rows.join(number, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item"), "item-blocks")
    for b in range(blocks):
        part = rows.where(F.col("block") == b) if blocks > 1 else rows
        block = Block([(r.item_id, r.term) for r in part.select("item_id", "term").toLocalIterator()])
        if block.size:
            yield spark.sparkContext.broadcast(block), block.size


def _statistics(docs: DataFrame, sent, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequency of each term of the block."""

    def run(batches):
        block, df, n_docs, n_terms = sent.value, np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for cut in slices(batch, "text"):
                n, _, term, _ = block.counted(cut.column(1))
                df += np.bincount(term, minlength=size)
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [n_docs, n_terms]))], ["term", "n"])

    df, totals = np.zeros(size, np.int64), {-1: 0, -2: 0}
    for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.term < 0:
            totals[r.term] = int(r.n)
        else:
            df[r.term] = r.n
    return totals[-1], totals[-2], df


class _Best:
    """The best rows of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)
        self.rows, self.extra = np.zeros((0, 4), np.int64), []  # item, score, 1 without an id, id

    def add(self, item: np.ndarray, score: np.ndarray, no_id: np.ndarray, doc: np.ndarray) -> None:
        self.extra.append(np.stack([item, score, no_id, doc], 1))
        if sum(map(len, self.extra)) > CELLS:
            self.cut()

    def cut(self) -> None:
        rows = np.concatenate([self.rows, *self.extra])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0], "left")
        place = np.arange(len(rows)) - first
        last = rows[place == self.top - 1]
        self.floor[last[:, 0]] = last[:, 1]
        self.rows, self.extra = rows[place < self.top], []


def _scores(docs: DataFrame, sent, n_docs: int, n_terms: int, weight: np.ndarray, top: int) -> DataFrame:
    def run(batches):
        block = sent.value
        n_items = len(block.ids)
        best, step = _Best(n_items, top), max(1, CELLS // n_items)
        holders = np.diff(block.first)
        for batch in batches:
            for cut in slices(batch, "text"):
                ids = cut.column(0)
                no_id, doc_id = np.array(ids.is_null(), np.int64), np.array(ids.fill_null(0), np.int64)
                n, doc, term, tf = block.counted(cut.column(1))
                m = np.array([50 + 50 * int(x) * n_docs // n_terms if x else 0 for x in n], np.int64)  # Python's integers: the product may pass 64 bits
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                for low in range(0, cut.num_rows, step):
                    at = slice(*np.searchsorted(doc, [low, low + step]))
                    t, k = term[at], holders[term[at]]
                    item = block.items[np.repeat(block.first[t] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                    cells = np.zeros(min(step, cut.num_rows - low) * n_items, np.int64)
                    np.add.at(cells, np.repeat(doc[at] - low, k) * n_items + item, np.repeat(value[at], k))
                    found = np.flatnonzero(cells.reshape(-1, n_items) >= best.floor)
                    row = found // n_items + low
                    best.add(found % n_items, cells[found], no_id[row], doc_id[row])
        best.cut()
        item, score, no_id, doc = best.rows.T
        item = pa.array([block.ids[k] for k in item], pa.int64())
        yield pa.RecordBatch.from_arrays([item, pa.array(doc, mask=no_id > 0), pa.array(score)], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def ranking(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """The `top` best documents of each item: item_id, rank int, doc_id, score.

    docs needs doc_id and text, items item_id and text; other columns are ignored.  Null, empty and term-less texts count for nothing
    and match nothing.  Every document row is ranked by itself, so a repeated row takes one rank each time; among equal scores the
    smaller doc_id comes first and rows without an id last.  Rows that share an item_id (or have none) are one item of all their
    terms.  Items that match nothing have no rows; empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for sent, size in _blocks(items):
        n_docs, n_terms, df = _statistics(docs, sent, size)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = _scores(docs, sent, n_docs, n_terms, weight, top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    out = out.withColumn("_salt", F.spark_partition_id() % SALTS)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")
