"""Operator 10: toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are tokens (runs of letters and digits, A-Z folded).  A token's vector holds what the
training rows say of it as a word and of its character grams (3, 5 and 7 bytes, with marks
for the token's ends): smoothed log odds of label 1, by hashed bucket.  In training each
document's own count is left out, so rare words do not give its label away.  The network reads overlapping windows; a document's score is its
highest window's, and training takes the gradient through that window.

The model is fitted in one task from a bounded sample of labelled rows and has a fixed size; every whole
text is scored in the tasks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import gru
from .common import _BYTE, _COEF, U64, flat, mix, slices, word_hashes, words

WINDOW, STRIDE = 64, 48
BITS = 17
GRAMS = (3, 5, 7)
MOST = {1: 600, 0: 1800}  # labelled rows of each class in the sample
LONGEST = 20_000  # bytes of a text in the sample
EPOCHS = 16
CHUNK = 64  # documents of the sample whose buckets are counted at a time
INPUTS = 4 + 2 * len(GRAMS)

_SEP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Tokens:
    """Tokens of texts, numbered by distinct token, with the buckets of each distinct one."""

    def __init__(self, col):
        data, off = flat(col)
        data = _FOLD[data]
        starts, ends, self.first = words(data, off, _SEP)
        h = word_hashes(data, starts, ends, False)
        _, at, self.number = np.unique(h, return_index=True, return_inverse=True)
        h = h[at]
        self.word = np.stack([(h >> U64(64 - BITS)).astype(np.int64), (mix(h + U64(5)) >> U64(64 - BITS)).astype(np.int64)])
        self.size = (ends - starts)[at] + 2
        self.base = np.concatenate([[0], np.cumsum(self.size)])
        text = np.full(self.base[-1], 3, np.uint8)  # 2 opens a token, 3 closes it
        inner = np.ones(len(text), bool)
        inner[self.base[:-1]] = inner[self.base[1:] - 1] = False
        text[self.base[:-1]] = 2
        n = (self.size - 2).astype(np.int64)
        text[inner] = data[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        last = np.repeat(self.base[1:], self.size)
        self.grams = []
        for g in GRAMS:
            total = np.zeros(max(0, len(text) - g + 1), U64)
            for j in range(g):
                total += _BYTE[text[j : j + len(total)]] * _COEF[j]
            bucket = (mix(total) >> U64(64 - BITS)).astype(np.int64)
            bucket = np.concatenate([bucket, np.zeros(len(text) - len(bucket), np.int64)])
            self.grams.append((bucket, np.arange(len(text)) + g <= last))

    def vectors(self, tables: dict[str, np.ndarray]) -> np.ndarray:
        """One row for each distinct token and a last row of zeros."""
        out = np.zeros((len(self.size) + 1, INPUTS), np.float32)
        if not len(self.size):
            return out
        a, b = tables["w0"][self.word[0]], tables["w1"][self.word[1]]
        out[:-1, 0], out[:-1, 1], out[:-1, 2] = a, b, np.where(np.abs(a) < np.abs(b), a, b)
        out[:-1, 3] = np.log(self.size) - 2
        for i, (bucket, ok) in enumerate(self.grams):
            odds = tables[f"g{i}"][bucket]
            out[:-1, 4 + 2 * i] = np.maximum(np.maximum.reduceat(np.where(ok, odds, -9), self.base[:-1]), -2)
            out[:-1, 5 + 2 * i] = np.add.reduceat(np.where(ok, odds, 0), self.base[:-1]) / np.maximum(np.add.reduceat(ok, self.base[:-1], dtype=np.int64), 1)
        return out

    def documents_by_bucket(self, a: int, b: int, y: np.ndarray, counts: dict[str, np.ndarray]) -> None:
        """Adds to counts, by table, label and bucket, how many of the texts a to b hold a token or gram of the bucket."""
        n = np.diff(self.first[a : b + 1])
        doc = np.repeat(np.arange(b - a, dtype=np.int64), n)
        pairs = np.unique(doc << 32 | self.number[self.first[a] : self.first[b]])
        doc, token = pairs >> 32, pairs & 0xFFFFFFFF
        n = self.size[token]
        at = np.repeat(self.base[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        wide = np.repeat(doc, n)
        for name, table in counts.items():
            k = int(name[1:])
            if name[0] == "w":
                who, bucket = doc, self.word[k][token]
            else:
                gram, ok = self.grams[k]
                inside = ok[at]
                who, bucket = wide[inside], gram[at[inside]]
            seen = np.unique(who << BITS | bucket)
            bucket, label = seen & (2**BITS - 1), y[a + (seen >> BITS)] == 1
            for v in (0, 1):
                table[v] += np.bincount(bucket[label == v], minlength=2**BITS)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first token, text) of all overlapping windows; the last one of a text may be shorter."""
        n = np.diff(self.first)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), count)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return self.first[text] + turn * STRIDE, text

    def grid(self, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers (step, window), the zero row beyond the text, and the mask."""
        at = start + np.arange(WINDOW)[:, None]
        mask = at < self.first[text + 1]
        return np.where(mask, self.number[np.minimum(at, len(self.number) - 1)], len(self.size)), mask

    def scores(self, model: dict) -> np.ndarray:
        """Logit of each text: of its highest window, or that of empty texts where it has no token."""
        p = model["network"]
        out = np.full(len(self.first) - 1, model["empty"], np.float32)
        start, text = self.windows()
        if not len(start):
            return out
        top = np.full(len(out), -np.inf, np.float32)
        v = self.vectors(model["tables"])
        forward, backward = v @ p["fW"] + p["fb"], v @ p["bW"] + p["bb"]
        order = np.argsort(np.minimum(self.first[text + 1] - start, WINDOW), kind="stable")
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            which, mask = self.grid(start[part], text[part])
            steps = int(mask.any(1).sum())
            which, mask = which[:steps], mask[:steps]
            np.maximum.at(top, text[part], gru.logits_of(p, forward[which], backward[which], mask))
        return np.where(np.isfinite(top), top, out)


def _odds(one: np.ndarray, zero: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed log odds of a bucket against those of all rows: 0 where it was never seen."""
    share = n1 / (n1 + n0)
    return np.clip(np.log((one + 6 * share) / (zero + 6 * (1 - share)) * (1 - share) / share), -2, 4).astype(np.float32)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> dict:
    """Fits tables and network on (text, label) rows."""
    tokens = Tokens(pa.array([t for t, _ in rows], pa.string()))
    y = np.array([label for _, label in rows], np.float32)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    network = gru.fresh(INPUTS, 8, 8)
    none = np.diff(tokens.first) == 0
    share = (y[none].sum() + 0.1) / (none.sum() + 1)  # of label 1 among texts without a token, 0.1 where there are none
    empty = float(np.log(share / (1 - share)))
    names = ["w0", "w1", *(f"g{i}" for i in range(len(GRAMS)))]
    if not n1 or not n0:  # nothing to learn from
        network["c"][0] = 0 if n1 == n0 else (4 if n1 else -4)
        network["o"][:] = 0
        return {"network": network, "tables": {k: np.zeros(2**BITS, np.float32) for k in names}, "empty": empty}
    counts = {k: np.zeros((2, 2**BITS), np.int64) for k in names}
    for a in range(0, len(rows), CHUNK):  # documents that hold a bucket, by label, a few documents at a time
        tokens.documents_by_bucket(a, min(a + CHUNK, len(rows)), y, counts)
    tables = {k: _odds(a, b, n1, n0) for k, (b, a) in counts.items()}
    left_out = [
        tokens.vectors({k: _odds(a, np.maximum(b - 1, 0), n1, n0 - 1 or 1) for k, (b, a) in counts.items()}),
        tokens.vectors({k: _odds(np.maximum(a - 1, 0), b, n1 - 1 or 1, n0) for k, (b, a) in counts.items()}),
    ]
    start, text = tokens.windows()
    if not len(start):
        return {"network": network, "tables": tables, "empty": empty}
    label = y[text].astype(int)
    r = np.random.default_rng(11)

    def inputs(part):
        which, mask = tokens.grid(start[part], text[part])
        return np.where(label[part][:, None] == 1, left_out[1][which], left_out[0][which]), mask

    def best(score):
        order = np.lexsort((score, text))
        return order[np.concatenate([text[order][1:] != text[order][:-1], [True]])]

    score = np.concatenate([(lambda x, m: np.maximum(x[:, :, [2, 4, 6, 8]], 0).sum((0, 2)))(*inputs(np.arange(i, min(i + 2048, len(start))))) for i in range(0, len(start), 2048)])
    adam = gru.Adam(network, 0.01)
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 2 == 0:
            score = np.concatenate([gru.logits(network, *inputs(np.arange(i, min(i + 2048, len(start))))) for i in range(0, len(start), 2048)])
        adam.rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
        chosen = r.permutation(best(score))
        for i in range(0, len(chosen), 64):
            part = chosen[i : i + 64]
            x, mask = inputs(part)
            _, g = gru.gradients(network, x, mask, y[text[part]], np.full(len(part), 1 / len(part), np.float32))
            adam.step(network, {k: np.clip(v, -1, 1) for k, v in g.items()})
    return {"network": network, "tables": tables, "empty": empty}


def fit_on(docs: DataFrame, labels: DataFrame, spared: int = 2) -> dict:
    """Fits on labelled rows whose crc32(doc_id as text) mod 4 is not `spared`: of each label the MOST[label] first
    by a hash of the id, of texts up to LONGEST bytes.  Null labels are left out; of repeated labels the highest counts."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(crc != spared).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.octet_length("text") <= LONGEST)
    turn = [F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")]

    def first(rows: DataFrame, times: int, *order) -> DataFrame:
        """The first rows of each label; tasks keep their own first ones before the exchange."""
        n = F.row_number().over(W.partitionBy("y").orderBy(*order))
        most = F.when(F.col("y") == 1, times * MOST[1]).otherwise(times * MOST[0])
        return rows.withColumn("n", n).where(F.col("n") <= times * max(MOST.values())).where(F.col("n") <= most).drop("n")

    # twice as many ids as rows are wanted, as some may have no text of that length; an id with many rows does not add to the sample
    ids = F.broadcast(first(known, 2, *turn))  # at most 2 * sum(MOST) rows
    sample = first(texts.join(ids, "doc_id"), 1, *turn, "text")

    def run(batches):  # at most sum(MOST) rows of LONGEST bytes
        rows = sorted((d, t, y) for b in batches for d, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([x[1:] for x in rows]))], pa.binary())], ["model"])

    # fitted in a task, so neither the sample nor the training takes the driver's memory
    made = sample.select("doc_id", "text", "y").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else fit([])


def scored(docs: DataFrame, model: dict, spared: int = 2, threshold: float = 0.3) -> DataFrame:
    """Scores every whole text.

    docs needs doc_id and text; other columns are ignored.  Returns for each row: doc_id, held_out
    (crc32(doc_id as text) mod 4 is `spared`; false for a null id), score, predicted (score >= threshold).
    Null texts, and those without a token, get the share of label 1 among such training rows.  An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: tables of 2**BITS and a small network

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = gru.sigmoid(Tokens(part.column(1)).scores(sent.value).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == spared, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns and without an exchange."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = gru.sigmoid(Tokens(part.column(part.schema.get_field_index("text"))).scores(sent.value).astype(np.float64))
                yield part.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
