"""Operator 7: quality by hierarchical empirical Bayes.

Each text gets evidence from a logistic classifier over shape features (fitted on a bounded sample of labelled
rows).  The evidence of all documents is summed by host and by path.  Hosts shrink toward the
global mean and paths toward their host, with prior strengths fitted to the spread between groups (method
of moments): a sparse site keeps near its prior, a large one speaks for itself.  A document's score
adds, in log odds, how its path departs from the global mean to its own evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, flat, slices, stored, word_hashes, words

MOST = 4000  # labelled rows in the classifier's sample
LONGEST = 20_000  # bytes of a text in the sample
FEATURES = 14


def _rate(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[off]) / np.maximum(np.diff(off), 1)


def features(col) -> np.ndarray:
    """Shape of each whole text: rates of kinds of characters, word lengths, repeats of words, word pairs and lines."""
    data, off = flat(col)
    starts, ends, first = words(data, off)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    h = word_hashes(data, starts, ends, True)

    def repeated(x, who):
        order = np.argsort(x)
        order = order[np.argsort(who[order].astype(np.uint16), kind="stable")]  # a slice has fewer than 65536 texts
        x, sorted_who = x[order], who[order]
        again = (x[1:] == x[:-1]) & (sorted_who[1:] == sorted_who[:-1])
        return np.bincount(sorted_who[1:][again], minlength=len(n)) / np.maximum(np.bincount(who, minlength=len(n)), 1)

    inner = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    same = np.bincount(doc[1:][inner & (h[1:] == h[:-1])], minlength=len(n)) if len(doc) else np.zeros(len(n))
    pairs = (h[1:] * U64(3) + h[:-1])[inner] if len(doc) else h
    length = (ends - starts).astype(float)
    mean = lambda x: np.bincount(doc, x, len(n)) / np.maximum(n, 1)
    upper = (data >= 65) & (data <= 90)
    symbol = np.isin(data, np.frombuffer(b"#$%&*+<=>@^_`{|}~\\/[]()", np.uint8))
    out = np.stack(
        [
            _rate(symbol, off), _rate(data == 124, off), _rate(data == 33, off), _rate(upper, off), _rate((data >= 48) & (data <= 57), off),
            _rate(data == 10, off), _rate((data == 46) | (data == 44), off), np.log1p(n), mean(length) / 10, np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 10,
            same / np.maximum(n, 1), repeated(h, doc), repeated(pairs, doc[1:][inner] if len(doc) else doc), _rate((data < 128) & ~symbol, off),
        ],
        1,
    )
    return out.astype(np.float64)


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -4, 4)
    return np.concatenate([np.ones((len(z), 1)), z, z * z / 4, np.sqrt(np.abs(z))], 1)


def fit(rows: list[tuple[str, int]]) -> dict:
    """Penalised logistic regression by Newton steps on (text, label) rows."""
    if not rows:
        return {"centre": np.zeros(FEATURES), "scale": np.ones(FEATURES), "w": np.zeros(1 + 3 * FEATURES)}
    x = features(pa.array([t for t, _ in rows], pa.string()))
    y = np.array([v for _, v in rows], float)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    d = _design(x, centre, scale)
    w = np.zeros(d.shape[1])
    ridge = np.eye(len(w)) * 0.5
    ridge[0, 0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve(d.T @ (d * (p * (1 - p) + 1e-6)[:, None]) + ridge, d.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"centre": centre, "scale": scale, "w": w}


def fit_on(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits on at most MOST labelled rows, the first by a hash of the id, of texts up to LONGEST bytes.  Null labels are left out."""
    turn = F.xxhash64(F.lit(5), "doc_id")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    picked = known.orderBy(turn, "doc_id").limit(MOST)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.octet_length("text") <= LONGEST)
    texts = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one of a repeated id's texts
    return fit([(r.text, r.y) for r in sorted(texts.select("doc_id", "text", "y").collect())])  # at most MOST texts of LONGEST bytes


def _strength(groups: DataFrame, mean: str) -> float:
    """Strength of the beta prior between groups, from sums over all of them: the spread of group means beyond what
    their sizes explain.  One row comes to the driver."""
    v = F.col(mean) * (1 - F.col(mean))
    got = groups.where("n > 1").agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2), F.sum(v), F.sum("n"), F.sum(F.col("n") * v), F.count(F.lit(1))).first()
    if not got[4]:
        return 1e6
    between = max(0.0, (got[0] - got[1]) / got[2])  # weighted variance of means, less the binomial part
    inner = got[3] / got[2]
    return float(min(1e6, max(2.0, inner / between - 1))) if between > 0 else 1e6


def scored(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """Quality of every document.

    docs needs doc_id, text, host and path (of the site); other columns are ignored.  Returns for
    each row: doc_id, evidence (of the text alone), host_posterior, path_posterior, score and keep (score >= threshold).
    Null texts count as empty; a null host or path is a group of its own.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("host").cast("string"), F.col("path").cast("string"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                z = _design(features(part.column(1)), model["centre"], model["scale"]) @ model["w"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "host", "path", "evidence"])

    seen = stored(docs.mapInArrow(run, "doc_id long, host string, path string, evidence double"), "evidence")
    seen = seen.withColumns({"h": F.coalesce("host", F.lit("\0null")), "p": F.coalesce("path", F.lit("\0null"))})
    paths = stored(seen.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    mean = min(1 - 1e-6, max(1e-6, s / n if n else 0.5))
    hosts = hosts.withColumn("mean", F.lit(mean))
    k = _strength(hosts, "mean")
    hosts = hosts.select("h", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_posterior"))
    paths = stored(paths.join(hosts, "h"), "sites")
    k = _strength(paths, "host_posterior")
    paths = paths.select("h", "p", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-9)) / F.greatest(1 - c, F.lit(1e-9)))
    total = odds(F.col("evidence")) + odds(F.col("path_posterior")) - float(np.log(mean / (1 - mean)))
    out = seen.join(paths, ["h", "p"]).withColumn("score", 1 / (1 + F.exp(-total)))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).cast("int").alias("keep"))
