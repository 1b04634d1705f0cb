"""Calls and results of tools, and links between events by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def in_order(*more) -> object:
    return W.partitionBy("session_id").orderBy("sequence", *more)


def tool_pairs(events: DataFrame) -> DataFrame:
    """Every call with its result; the last call and the last result of an id win.  Left: calls without a result stay."""
    last = lambda c: F.max_by(c, "sequence")
    side = events.where("tool_use_id is not null")
    calls = side.where("event_type = 'tool_call'").groupBy("session_id", "tool_use_id").agg(last("event_id").alias("call_event_id"), last("tool_name").alias("tool_name"))
    results = side.where("event_type = 'tool_result'").groupBy("session_id", "tool_use_id").agg(last("event_id").alias("result_event_id"), last("error_detected").alias("error_detected"))
    return calls.join(results, ["session_id", "tool_use_id"], "left")


def preceding_call(events: DataFrame) -> DataFrame:
    """Adds to each event the last call with its tool_use_id at or before it (call_event_id, call_tool); one window and no join."""
    w = W.partitionBy("session_id", "tool_use_id").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0)
    call = F.last(F.when(F.col("event_type") == "tool_call", F.struct("event_id", "tool_name")), True).over(w)
    return events.withColumns({"call_event_id": F.when(F.col("tool_use_id").isNotNull(), call["event_id"]), "call_tool": F.when(F.col("tool_use_id").isNotNull(), call["tool_name"])})


def next_within(events: DataFrame, what: Column, reach: int, name: str) -> DataFrame:
    """Forward as-of: the first non-null `what` in the following `reach` events of the session."""
    return events.withColumn(name, F.first(what, True).over(in_order().rowsBetween(1, reach)))


def last_within(events: DataFrame, what: Column, reach: int, name: str) -> DataFrame:
    """Backward as-of: the last non-null `what` in the `reach` events before."""
    return events.withColumn(name, F.last(what, True).over(in_order().rowsBetween(-reach, -1)))


def merged_windows(hits: DataFrame, reach: int) -> DataFrame:
    """Windows of `reach` around hits (session_id, sequence), merged where they strictly overlap: (session_id, low, high)."""
    w = in_order().rowsBetween(W.unboundedPreceding, -1)
    span = hits.select("session_id", "sequence").distinct().withColumns({"low": F.greatest(F.col("sequence") - reach, F.lit(0)), "high": F.col("sequence") + reach})
    span = span.withColumn("new", (F.coalesce(F.max("high").over(w), F.lit(-1)) < F.col("low")).cast("int"))
    group = F.sum("new").over(in_order().rowsBetween(W.unboundedPreceding, 0))
    return span.withColumn("g", group).groupBy("session_id", "g").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("g")


def context(events: DataFrame, hits: DataFrame, reach: int) -> DataFrame:
    """Events in the merged windows around hits, with is_match."""
    spans = merged_windows(hits, reach)
    near = events.join(spans, "session_id").where("sequence between low and high").drop("low", "high")
    marks = hits.select("session_id", "sequence").distinct().withColumn("is_match", F.lit(True))
    return near.join(marks, ["session_id", "sequence"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))
