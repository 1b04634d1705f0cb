"""Operator 5: mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and passed over up to `repeats` times.  A copy's
virtual finish time is the words of its source up to its end, divided by the source's target;
copies of all sources are sorted by it and taken until the total budget is used up.  So at any
moment each source has had its share, and the cut lands near every target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, ranked, stored


def words_of(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Table (source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating; they share `share` of all words.
    No target is above `repeats` times its source; the excess goes to the others by weight until
    none is above.  Only sums over sources come to the driver, once a round; sources are rows
    of a summary, one for each source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("pos", F.lit(len(weights))) + 1).cast("int"))
    # null last; Spark compares strings by their UTF-8 bytes, which is code-point order
    table = stored(ranked(sizes, [F.asc_nulls_last("source")], name="sources").select("source", "source_size", w.cast("double").alias("weight"), (F.col("source_size") * float(repeats)).alias("cap")), "weights")
    budget = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        used, left, n = table.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(full.cast("int")), F.lit(0))).first()
        if n == capped or not left:
            break
        capped, level = n, max(0.0, budget - used) / left
    return table.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """How often each document goes into the mix.

    docs needs doc_id, source and size (words); other columns are ignored.  Returns for each row:
    doc_id, source, size, source_size, target, copies, taken (size * copies).  Documents
    without words are never taken.  Rows that repeat are taken one by one; ties are broken by doc_id
    and size, so reruns agree.  An empty table gives an empty result.
    """
    docs = stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("size").cast("long")), "mix")
    goals = stored(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats), "targets")
    budget = int(goals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    order = [F.asc_nulls_last("source"), F.xxhash64(F.lit(seed), "doc_id", "size").asc(), F.asc_nulls_first("doc_id"), F.asc("size")]
    queue = ranked(docs, order, "size", name="queue").withColumnsRenamed({"pos": "row", "before": "earlier"})
    # words of all earlier sources, from the summary of sources
    firsts = ranked(goals, [F.asc_nulls_last("source")], "source_size", name="firsts").select(F.col("source").alias("s"), "source_size", "target", F.col("before").alias("source_start"))
    queue = stored(queue.join(firsts, queue["source"].eqNullSafe(firsts["s"])).select("row", "doc_id", "source", "size", "source_size", "target", (F.col("earlier") - F.col("source_start") + F.col("size")).alias("ends")), "queue")
    copies = queue.where("size > 0").select("row", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"), "source_size", "ends", "target").where("target > 0")
    finish = ((F.col("ends") + F.col("turn") * F.col("source_size")) / F.col("target")).alias("finish")
    timed = copies.select("row", "size", "turn", finish)
    taken = ranked(timed, [F.asc("finish"), F.asc("row"), F.asc("turn")], "size", name="finish")
    taken = taken.where(F.col("before") + F.col("size") <= budget).groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    out = queue.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
