"""Operator 8: substring dedup by seed and extend.

Seeds are winnowed anchors: of all word 8-grams of each run of `length` words, the smallest hash.
Equal runs choose the same anchors, so a run that repeats has an anchor that repeats.  Anchors
are grouped by hash; those at more than one place are extended both ways to all runs that
chose them, and runs of equal words are grouped to find each run's earliest place.  Runs
that also start earlier and overlap or touch make up the maximal repeats of at least `length` words; their words go.

Both groupings travel packed and are reduced within a task first: of places with one hash only
the earliest is sent on, the others are known to repeat.  So a passage that a third of the
documents share puts at most one place a slice of text into a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, dropped, flat, gram_hashes, slices, stored, word_hashes, words

GRAM = 8
GROUP_ROWS = 1_500_000
NULL_ID = -(2**63)  # a null doc_id counts as the smallest one
PACKED = "bucket int, hashes binary, docs binary, starts binary, doc long, known binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("doc", pa.int64()), ("known", pa.binary())])


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n values in a row."""
    size = 1
    while size * 2 <= n:
        x = pick(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size and len(x) > n - size else x if n == size else x[:0]


def _runs(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs inside one text, their smallest gram hash, all gram hashes and the texts of the words."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = gram_hashes(h, GRAM)
    low = _slide(grams, length - GRAM + 1, np.minimum)
    inside = np.flatnonzero(np.arange(len(low)) + length <= first[1:][doc[: len(low)]]) if len(low) else np.zeros(0, np.int64)
    return inside, low, grams, doc


def _anchors(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all anchors, their hashes and texts."""
    inside, low, grams, doc = _runs(h, first, length)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    span = length - GRAM + 1
    valid = np.zeros(len(grams) + span - 1, U64)  # smallest hash of the run that starts at i - span + 1
    valid[inside + span - 1] = low[inside]
    high = _slide(valid, span, np.maximum)[: len(grams)]
    at = np.flatnonzero((high == grams) & (grams > 0))
    return at, grams[at], doc[at]


def _packed(hashes, docs, starts, bits: int):
    """Rows of one slice: the earliest place of each hash, dealt by the hash; the other places, by text, as known to repeat (and
    the earliest of such a hash too, if `hashes` are anchors)."""
    bucket = (hashes >> U64(64 - bits)).astype(np.int64)
    edge = np.searchsorted(bucket, np.arange(2**bits + 1))
    full = np.flatnonzero(np.diff(edge))
    cut = lambda x: pa.array([x[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary())
    n = len(full)
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(hashes), cut(docs), cut(starts.astype(np.uint32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_SCHEMA)


def _by_doc(docs, starts):
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order].astype(np.uint32)
    edge = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]])) if len(docs) else np.zeros(1, np.int64)
    return docs[edge[:-1]], [starts[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _known(docs, starts):
    who, packed = _by_doc(docs, starts)
    n = len(who)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(3)), pa.array(who, pa.int64()), pa.array(packed, pa.binary())], schema=_SCHEMA)


def _sorted(hashes, docs, starts):
    """Ordered by hash, text and start; whether the hash is new, and whether it comes at one place only."""
    order = np.lexsort((starts, docs, hashes))
    hashes, docs, starts = hashes[order], docs[order], starts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes, docs, starts, new


def _ids(batch, name="doc_id"):
    return np.array([NULL_ID if d is None else d for d in batch.column(batch.schema.get_field_index(name)).to_pylist()], np.int64)


def _seed(length: int, bits: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column(1))
                starts, ends, first = words(data, off)
                at, hashes, doc = _anchors(word_hashes(data, starts, ends, False), first, length)
                hashes, docs, places, new = _sorted(hashes, _ids(part)[doc], at - first[doc])
                yield _packed(hashes[new], docs[new], places[new], bits)
                again = ~new
                again[:-1] |= ~new[1:]  # the first place of a repeated anchor is known too
                yield _known(docs[again], places[again])

    return run


def _extend(length: int, bits: int):
    """Runs that chose a repeated anchor."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column(1))
                starts, ends, first = words(data, off)
                h = word_hashes(data, starts, ends, False)
                inside, low, grams, doc = _runs(h, first, length)
                if not len(inside):
                    continue
                seed = np.zeros(len(h), bool)
                for i, places in enumerate(part.column(2).to_pylist()):
                    at = first[i] + np.frombuffer(b"".join(places), np.uint32).astype(np.int64)
                    seed[at[at < first[i + 1]]] = True
                seed = seed[: len(grams)]
                count = np.concatenate([[0], np.cumsum(seed)])
                # a run's anchor is one of its grams with its smallest hash
                chosen = inside[count[inside + length - GRAM + 1] > count[inside]]
                ok = np.zeros(len(chosen), bool)
                for j in range(length - GRAM + 1):
                    ok |= seed[chosen + j] & (grams[chosen + j] == low[chosen])
                chosen = chosen[ok]
                runs = gram_hashes(h, length)[chosen]
                hashes, docs, places, new = _sorted(runs, _ids(part)[doc[chosen]], chosen - first[doc[chosen]])
                yield _packed(hashes[new], docs[new], places[new], bits)
                again = ~new
                top = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
                again &= (docs != docs[top]) | (places != places[top])  # rows that repeat whole are one place
                yield _known(docs[again], places[again])

    return run


def _grouped(every: bool):
    """Places of hashes that come at more than one place: all of them, or all but the earliest."""

    def run(key, table):
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        hashes, docs, places, new = _sorted(joined("hashes", U64), joined("docs", np.int64), joined("starts", np.uint32).astype(np.int64))
        again = ~new
        if every:
            again[:-1] |= ~new[1:]
        elif len(new):
            top = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again &= (docs != docs[top]) | (places != places[top])
        who, packed = _by_doc(docs[again], places[again])
        return pa.table({"doc": pa.array(who, pa.int64()), "known": pa.array(packed, pa.binary())})

    return run


def _kept(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_removed, digests = [], [], []
                for text, found in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    w = (text.as_py() or "").encode().split()
                    n_words.append(len(w))
                    starts = np.frombuffer(b"".join(found or ()), np.uint32).astype(np.int64)
                    starts = starts[starts + length <= len(w)]
                    if len(starts):
                        step = np.zeros(len(w) + 1, np.int64)
                        np.add.at(step, starts, 1)
                        np.add.at(step, starts + length, -1)
                        keep = np.cumsum(step)[:-1] == 0
                        w = [w[i] for i in np.flatnonzero(keep)]
                    n_removed.append(n_words[-1] - len(w))
                    digests.append(b" ".join(w))
                kept = [b.decode() for b in digests]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in digests]), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """Removes each word covered by a run of `length` words that also starts earlier
    (at a smaller doc_id, or earlier in the same document); runs are judged on the input.

    docs needs doc_id and text; other columns are ignored.  Returns for each row: doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space, UTF-8) and kept, that text.
    Null and blank texts have no words.  A null doc_id counts as the smallest.  Rows that repeat whole are
    one place: they keep the same words.  An empty table gives an empty result.
    """
    if length <= GRAM:
        raise ValueError(f"runs must be longer than {GRAM} words")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    groups = lambda rows: max(6, int(np.ceil(np.log2(max(1, rows / GROUP_ROWS)))))

    def repeats(packed: DataFrame, every: bool, name: str) -> DataFrame:
        """(doc, places): of hashes at several places."""
        packed = stored(packed, f"{name}-places", release=True)
        shared = packed.where("bucket is not null").groupBy("bucket").applyInArrow(_grouped(every), "doc long, known binary")
        known = packed.where("bucket is null").select("doc", "known")
        out = stored(shared.union(known).groupBy("doc").agg(F.collect_list("known").alias("places")), name, release=True)
        dropped(packed)
        return out

    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    seeds = repeats(docs.mapInArrow(_seed(length, groups(n_bytes / 40)), PACKED), True, "seeds")
    n_seeds = seeds.agg(F.coalesce(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))), F.lit(0))).first()[0] / 4
    near = keyed.join(seeds, "doc").select("doc_id", "text", "places")
    runs = repeats(near.mapInArrow(_extend(length, groups(n_seeds * 7)), PACKED), False, "runs")
    return keyed.join(runs, "doc", "left").select("doc_id", "text", "places").mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
