"""Connected components of an edge table by alternating large-star and small-star steps.

Each task first reduces the edges it holds to stars of their own components, so fewer edges and shorter chains travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dropped, stored


HELD = 1_000_000  # edges that a task reduces together


def _forest(batches):
    """Edges (u, v) to stars: each node but the smallest of a component of the edges at hand is linked to that one."""

    def stars(held):
        ends = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)]
        node, number = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = np.split(number, 2)
        top = np.arange(len(node))
        while len(a):
            a, b = top[a], top[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while (top[top] != top).any():
                top = top[top]
        k = np.flatnonzero(top != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[top[k]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each vertex links its larger neighbours to the smallest of its neighbourhood;
    small: each vertex links its smaller neighbours and itself to the smallest of them."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Table (node, label) of the nodes with edges; label is the smallest node of the component.

    Nulls and loops are left out.  The rounds grow with the logarithm of the longest chain; they end when all edges are
    stars, that is when no node has two edges up or one up and one down.  Only that answer of each round comes to the driver.
    """
    reduced = lambda df: df.mapInArrow(_forest, "u long, v long")
    now = stored(reduced(edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))), "edges")
    while True:
        before, now = now, stored(_star(_star(reduced(now), True), False), "stars")
        dropped(before)
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
