"""Operator 6: sharding by histogram sort.

Documents are keyed by the hash of their text, so equal texts are neighbours and, where the law
allows, share a shard.  Splitters between shards are found by counting: each round counts
the exact bytes below a grid of candidate boundaries in the range where each splitter must
lie, and narrows it, until the bytes below are within the tolerance of their aim.  A group of equal texts that
is larger than the tolerance is split at ids by the same search over a second key.  Then rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ranked, stored

LOW, HIGH = -(2**63), 2**63 - 1
PROBES = 32


def _search(keys: DataFrame, key: str, spans: list[list[int]], aims: list[float], base: list[float], near: float) -> list[tuple[int, float, float]]:
    """For each span (lowest, highest key) the boundary b whose bytes of keys < b (plus base) are next to the aim:
    (b, bytes below b, largest key found with no more bytes below it than the aim).  Only counts below probes come to the driver."""
    spans = [list(s) for s in spans]
    best: list[tuple] = [(s[0], b, s[0]) for s, b in zip(spans, base, strict=True)]
    while True:
        probes = sorted({s[0] + (s[1] - s[0]) * i // PROBES for s in spans for i in range(1, PROBES + 1) if s[1] > s[0]})
        if not probes:
            return best
        # one pass: bytes by the number of probes at or below the key
        below = sorted(keys.groupBy(_slot(key, probes).alias("slot")).agg(F.sum("size").alias("bytes")).collect())  # at most probes + 1 rows
        total, run, i = {}, 0, 0
        for n, p in enumerate(probes):
            while i < len(below) and below[i]["slot"] <= n:
                run += below[i]["bytes"]
                i += 1
            total[p] = run
        for k, s in enumerate(spans):
            if s[1] <= s[0]:
                continue
            mine = [p for p in probes if s[0] < p <= s[1]]
            low = max([p for p in mine if base[k] + total[p] <= aims[k]], default=None)
            high = min([p for p in mine if base[k] + total[p] > aims[k]], default=None)
            for p in (low, high):
                if p is not None and abs(base[k] + total[p] - aims[k]) < abs(best[k][1] - aims[k]):
                    best[k] = (p, base[k] + total[p], p)
            spans[k] = [s[0] if low is None else low, s[1] if high is None else high - 1]
            best[k] = (*best[k][:2], spans[k][0])
            if abs(best[k][1] - aims[k]) <= near:
                spans[k] = [0, 0]


def _slot(key: str, probes: list[int]):
    """Number of probes <= key, by halving: a balanced tree of comparisons."""

    def tree(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col(key) >= F.lit(probes[m]), tree(m + 1, b)).otherwise(tree(a, m))

    return tree(0, len(probes))


def shards(docs: DataFrame, n: int = 8, tolerance: float = 0.002) -> DataFrame:
    """Deals rows to n shards of nearly equal bytes (law ``bytes``).

    docs needs doc_id and text; other columns are ignored.  A row's size is the UTF-8 bytes of
    its text (null: none) plus 1.  Returns doc_id, size, text_crc32 (null text: of no bytes), law, shard,
    slot (0, 1, ... in each shard, by text hash and id) and grown_shard (null: it belongs to another law).
    Splitters are within tolerance / n of the bytes, or as near as single rows of one hash and id allow.
    Equal texts share a shard unless their group straddles a splitter that needs it.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"))
    slim = stored(slim.withColumn("h2", F.xxhash64("doc_id", "h")), "sized")
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    aims = [total * i / n for i in range(1, n)]
    near = tolerance * total / n
    first = _search(slim, "h", [[LOW, HIGH] for _ in aims], aims, [0.0] * len(aims), near)
    cuts = []
    for aim, (b, below, h) in zip(aims, first, strict=True):
        if abs(below - aim) <= near:
            cuts.append((b, LOW))
            continue
        # the group of hash h straddles the aim
        group = slim.where(F.col("h") == h)
        base = slim.where(F.col("h") < h).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        b2 = _search(group, "h2", [[LOW, HIGH]], [aim], [float(base)], near)[0][0]
        cuts.append((h, b2))
    after = [(F.col("h") > h) | ((F.col("h") == h) & (F.col("h2") >= h2)) for h, h2 in cuts]
    shard = sum((x.cast("int") for x in after), F.lit(0))
    order = [F.asc("h"), F.asc("h2"), F.asc_nulls_first("doc_id"), F.asc("size")]
    dealt = ranked(slim, order, name="dealt").withColumn("shard", shard.cast("int"))
    dealt = stored(dealt, "shards")
    starts = dealt.groupBy("shard").agg(F.min("pos").alias("start"))
    return dealt.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("pos") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
