"""Rebuilding files by folding recorded edits in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules


def apply_edit(text: Column, old: Column, new: Column, all_: Column) -> Column:
    """Replaces the first occurrence, or all; an empty, null or absent old text changes nothing."""
    new = F.coalesce(new, F.lit(""))
    at = F.instr(text, old)
    first = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))
    return F.when(old.isNull() | (old == "") | (at == 0), text).when(all_, F.replace(text, old, new)).otherwise(first)


def apply_edits(text: Column, edits: Column) -> Column:
    """Applies an array of (old_string, new_string, replace_all) in order."""
    return F.aggregate(edits, text, lambda acc, e: apply_edit(acc, e["old_string"], e["new_string"], F.coalesce(e["replace_all"], F.lit(False))))


EDIT = "array<struct<old_string:string,new_string:string,replace_all:boolean>>"


def file_states(events: DataFrame, targets: DataFrame | None = None, reads: DataFrame | None = None) -> DataFrame:
    """Content of each file of each session after all its edits, or up to a target (session_id, file_path, until).

    The fold starts at the last Write at or before the target, else at the first edit's old text; only
    edits from there on are gathered, so the array is as long as the fold.  An edit replaces the first occurrence, or every one
    (replace_all); a multi_edit folds its edits and counts once.  Files of reads (session_id, file_path, content: `snapshots`)
    that have no edit are as they were read.  Returns target columns, content, edits_applied and last_event_id.
    """
    key = ["session_id", "file_path"]
    edits = events.where(F.col("file_operation").isin(rules.EDITS) & (F.col("event_type") == "tool_call") & F.col("file_path").isNotNull())
    have = lambda c, kind: F.col(c) if c in events.columns else F.lit(None).cast(kind).alias(c)
    edits = edits.select(*key, "sequence", "event_id", "file_operation", "old_content", "new_content", have("replace_all", "boolean"), have("edits", EDIT))
    if targets is None:
        edits = edits.withColumn("until", F.lit(None).cast("long"))
    else:
        edits = edits.join(targets.select(*key, F.col("until").cast("long")), key).where("until is null or sequence <= until")
    by = [*key, "until"]
    start = F.max(F.when(F.col("file_operation") == "write", F.col("sequence")))
    heads = edits.groupBy(*by).agg(start.alias("from"))
    kept = edits.join(heads.withColumnRenamed("until", "u"), on=[*(edits[k] == heads[k] for k in key), edits["until"].eqNullSafe(F.col("u"))]).drop("u", *(heads[k] for k in key))
    kept = kept.where("from is null or sequence >= from")
    folded = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sequence", "event_id", "file_operation", "old_content", "new_content", "replace_all", "edits"))).alias("e"))
    first = F.when(F.col("e")[0]["file_operation"] == "write", F.lit("")).otherwise(F.coalesce(F.col("e")[0]["old_content"], F.lit("")))

    def step(acc: Column, e: Column) -> Column:
        one = F.array(F.struct(e["old_content"].alias("old_string"), e["new_content"].alias("new_string"), e["replace_all"].alias("replace_all")))
        these = F.when(e["file_operation"] == "edit", one).when(e["file_operation"] == "multi_edit", e["edits"])
        return F.when(e["file_operation"] == "write", F.coalesce(e["new_content"], F.lit(""))).otherwise(apply_edits(acc, F.coalesce(these, F.array().cast(EDIT))))

    content = F.aggregate("e", first, step)
    counted = F.size(F.filter("e", lambda e: e["file_operation"] != "notebook_edit")).cast("long")
    out = folded.select(*by, content.alias("content"), counted.alias("edits_applied"), F.element_at("e", -1)["event_id"].alias("last_event_id"))
    if reads is None:
        return out
    edited = events.where(F.col("file_operation").isin(rules.EDITS) & (F.col("event_type") == "tool_call")).select(*key).distinct()
    asked = reads.join(edited, key, "left_anti")
    asked = asked.withColumn("until", F.lit(None).cast("long")) if targets is None else asked.join(targets.select(*key, F.col("until").cast("long")), key)
    return out.unionByName(asked.select(*by, "content", F.lit(0).cast("long").alias("edits_applied"), F.lit(None).cast("string").alias("last_event_id")))


def sequence_at(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (session_id, file_path, event_id or ts, each may be null) with until: the event's sequence, else the last one at or
    before the time, else null (the end).  A time before all events gives -1, and an event that is not there the end."""
    t = targets.withColumn("_n", F.monotonically_increasing_id()) if "_n" not in targets.columns else targets
    e = events.select("session_id", F.col("event_id").alias("_e"), F.col("ts").alias("_t"), "sequence")
    by_id = t.join(e, (t["session_id"] == e["session_id"]) & (t["event_id"] == e["_e"])).groupBy("_n").agg(F.max("sequence").alias("_by_id"))
    timed = t.where("event_id is null and ts is not null").select("_n", "session_id", "ts")
    by_ts = timed.join(e, "session_id", "left").groupBy("_n").agg(F.coalesce(F.max(F.when(F.col("_t") <= F.col("ts"), F.col("sequence"))), F.lit(-1)).alias("_by_ts"))
    return t.join(by_id, "_n", "left").join(by_ts, "_n", "left").withColumn("until", F.coalesce("_by_id", "_by_ts")).drop("_n", "_by_id", "_by_ts")


def snapshots(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """First non-empty output of a Read of each file, from the paired result: for files without edits."""
    reads = events.where("event_type = 'tool_call' and file_operation = 'read'").select("session_id", "file_path", "sequence", F.col("event_id").alias("call_event_id"))
    out = events.where("event_type = 'tool_result'").select(F.col("event_id").alias("result_event_id"), "content")
    got = reads.join(pairs.select("call_event_id", "result_event_id"), "call_event_id").join(out, "result_event_id").where("content <> ''")
    return got.groupBy("session_id", "file_path").agg(F.min_by("content", "sequence").alias("content"))


def history(events: DataFrame, path: str) -> DataFrame:
    """Edits of files with this exact path or, where there is none, with the path in theirs; oldest first in each session."""
    edits = events.where(F.col("file_operation").isin(rules.EDITS) & (F.col("event_type") == "tool_call"))
    near = edits.where(F.contains("file_path", F.lit(path))).withColumn("exact", F.col("file_path") == path)
    any_ = near.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("any_exact"))  # one row
    kept = near.crossJoin(F.broadcast(any_)).where("exact or not any_exact")
    return kept.select("event_id", "session_id", "file_path", "ts", "sequence", "file_operation", "old_content", "new_content")


def history_totals(events: DataFrame, path: str) -> DataFrame:
    """One row a file of `history`: its edits by kind, its sessions and when it was edited first and last."""
    kind = lambda k: F.count_if(F.col("file_operation") == k).alias(f"{k}s")
    return history(events, path).groupBy("file_path").agg(kind("edit"), kind("write"), kind("multi_edit"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def plan_writes(events: DataFrame) -> DataFrame:
    """Edits of plan files, newest first."""
    at = events.where(F.col("file_operation").isin("write", "edit", "multi_edit") & F.col("file_path").like("%/.claude/plans/%.md"))
    return at.select("event_id", "session_id", "file_path", "ts", F.length("new_content").cast("long").alias("size")).orderBy(F.desc("ts"), "event_id")
