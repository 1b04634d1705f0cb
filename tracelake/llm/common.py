"""Shared pieces of the corpus operators: stored steps, words and hashes of whole texts.

Texts reach Python in Arrow batches.  A batch is cut into slices of a few MB
(one longer text is a slice of its own), so the numpy arrays of a task stay small
whatever the partition holds.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

U64 = np.uint64
SLICE_BYTES = 4 << 20
#: Python regex of a word in every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_rng = np.random.default_rng(20240229)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_COEF = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


# ---------------------------------------------------------------- stored steps

_local: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder for stored steps: spark.checkpoint.dir, or a fresh local one where it is unset and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-steps-", dir="/tmp")
        _local[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Writes a step as Parquet in the shared folder and reads it again.

    This cuts the lineage in a way that survives lost executors.  The shuffle files of a
    finished step go once the JVM has collected its garbage; release asks for that now, after a
    step that shuffles about as much as the input.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    for _ in range(2 * release):  # Python's references go first, then the JVM's
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored step that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list, amount: str | None = None, parts: int | None = None, name: str = "ranked") -> DataFrame:
    """Adds ``pos`` (row number from 0 in the global order) and, for an amount column,
    ``before`` (sum of the amount over all rows that come earlier).

    One range exchange; rows are numbered inside each partition and shifted by the totals of
    the partitions before, a table of one row a partition.  No task gets more than its range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = W.partitionBy("_part").orderBy(*order)
    cols = [F.row_number().over(w).cast("long").alias("_rn")]
    if amount:
        cols.append(F.coalesce(F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_run"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, name)
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), (F.sum(amount) if amount else F.lit(0)).cast("long").alias("_sum"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"))
    out = ranged.select("*", *cols).join(F.broadcast(shifts), "_part")  # at most `parts` rows
    out = out.withColumn("pos", F.col("_rn") - 1 + F.col("_n0"))
    if amount:
        out = out.withColumn("before", F.col("_run") + F.col("_s0"))
    return out.drop("_part", "_rn", "_run", "_n0", "_s0")


# ---------------------------------------------------------------- texts as arrays


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, one after the other, and n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch, text: str, most: int = SLICE_BYTES):
    """Cuts a record batch into runs of rows with about ``most`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        j = min(j, n, i + 60_000)
        yield batch.slice(i, j - i)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(way: str, n: int) -> np.ndarray:
    if len(_powers[way]) < n:
        base = _BASE if way == "up" else pow(_BASE, -1, 2**64)
        x = np.full(max(n, 1 << 20), base, U64)
        x[0] = 1
        _powers[way] = np.cumprod(x)
    return _powers[way][:n]


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text (and the end) the number of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    sep = separators[data]
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0] = right[-1] = True
    left[1:], right[:-1] = sep[:-1], sep[1:]
    left[off[off < n]] = True
    right[off[off > 0] - 1] = True
    starts, ends = np.flatnonzero(left & ~sep), np.flatnonzero(right & ~sep) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the words' bytes, the same at every place; lower folds A-Z."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * _power("up", len(data)), out=total[1:])
    down = _power("down", len(data) + 1)
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each place on."""
    out = np.zeros(max(0, len(hashes) - n + 1), U64)
    for j in range(n):
        out += hashes[j : j + len(out)] * _COEF[j]
    return mix(out + U64(n))


def shingles(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased texts: (hash, text number), sorted by text and hash, and the set sizes.

    A text of fewer than ``width`` words has its whole sequence as one shingle; without words it has none.
    """
    data, off = flat(col)
    starts, ends, first = words(data, off)
    h = word_hashes(data, starts, ends, True)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    ok = np.arange(len(h)) + width <= first[1:][doc] if len(h) else np.zeros(0, bool)
    feats, docs = [], []
    if ok.any():
        at = np.flatnonzero(ok)
        feats.append(gram_hashes(h, width)[at])
        docs.append(doc[at])
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            x = np.zeros(len(short), U64)
            for j in range(n):
                x += h[first[short] + j] * _COEF[j]
            feats.append(mix(x + U64(n)))
            docs.append(short)
    if not feats:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(count), np.int64)
    f, d = np.concatenate(feats), np.concatenate(docs)
    order = np.argsort(f)
    order = order[np.argsort(d[order].astype(np.uint16 if len(count) < 65536 else np.int64), kind="stable")]
    f, d = f[order], d[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    f, d = f[new], d[new]
    return f, d, np.bincount(d, minlength=len(count))
