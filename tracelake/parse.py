"""Entries to typed events, as columns over all lines of all transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import rules
from .functions.extract import gated_error, git_signal

BLOCK = "array<variant>"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def timestamp(text: Column) -> Column:
    """ISO time; without a zone it is UTC; missing or broken ones are the epoch."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")), F.timestamp_seconds(F.lit(0)))


def stringified(content: Column) -> Column:
    """A result's content: a string as it is, a list joined by line ends (text, content or JSON), null as empty."""
    items = F.transform(_get(content, "$", BLOCK), lambda b: F.coalesce(_get(b, "$.text"), _get(b, "$.content"), _get(b, "$")))
    return F.coalesce(F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(items, "\n")), _get(content, "$"), F.lit(""))


def summary(tool: Column, given: Column) -> Column:
    """Tool name and the known keys of its input, each cut at 500 characters."""
    parts = [F.concat(F.lit("Tool: "), F.coalesce(tool, F.lit("")))]
    for k in rules.SUMMARY_KEYS:
        v = F.nullif(_get(given, f"$.{k}"), F.lit(""))
        parts.append(F.concat(F.lit(f"{k}: "), F.when(F.length(v) > 500, F.concat(F.substring(v, 1, 500), F.lit("..."))).otherwise(v)))
    return F.concat_ws("\n", *parts)


def events(lines: DataFrame, after: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Events of (path, line_no, raw) lines.

    One exchange by file serves numbering, ids and the link from results to the calls before them.  Where the lines go on from
    earlier ones of their files, after (path, events) tells how many events those gave, and calls (path, tool_use_id, tool_name, command) which
    calls were among them; both have one row a key.
    """
    v = F.try_parse_json("raw")
    e = lines.select("path", "line_no", "raw", v.alias("v")).where("v is not null")
    kind = F.coalesce(_get(F.col("v"), "$.type"), F.lit("unknown"))
    content = _get(F.col("v"), "$.message.content", "variant")
    e = e.withColumns({"kind": kind, "content_v": content}).where(~F.col("kind").isin("queue-operation", "progress"))
    text_block = F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), _get(F.col("content_v"), "$").alias("text")))))
    shape = F.schema_of_variant("content_v")
    blocks = F.when(shape.startswith("ARRAY"), _get(F.col("content_v"), "$", BLOCK)).when(shape == "STRING", text_block)
    e = e.withColumn("blocks", F.when(F.col("kind").isin("user", "assistant"), blocks))
    b = e.select("*", F.posexplode_outer("blocks").alias("offset", "b")).withColumn("offset", F.coalesce("offset", F.lit(0)))
    type_ = _get(F.col("b"), "$.type")
    is_user, is_bot = F.col("kind") == "user", F.col("kind") == "assistant"
    said, thought = _get(F.col("b"), "$.text"), _get(F.col("b"), "$.thinking")
    event_type = (
        F.when(is_user & (type_ == "tool_result"), "tool_result").when(is_user, "user_message")
        .when(is_bot & (type_ == "text") & (F.trim(said) != ""), "assistant_text").when(is_bot & (type_ == "thinking") & (F.trim(thought) != ""), "assistant_thinking").when(is_bot & (type_ == "tool_use"), "tool_call")
        .when(is_bot, F.lit(None)).when(F.col("kind") == "system", "system").when(F.col("kind") == "file-history-snapshot", "file_snapshot").otherwise("unknown")
    )
    b = b.withColumn("event_type", event_type).where("event_type is not null")
    tool, given = _get(F.col("b"), "$.name"), _get(F.col("b"), "$.input", "variant")
    other = F.when(type_ == "image", F.concat(F.lit("[image: "), F.coalesce(_get(F.col("b"), "$.source.media_type"), F.lit("image")), F.lit("]"))).when(type_.isNotNull(), F.concat(F.lit("["), type_, F.lit("]"))).otherwise(F.lit(""))
    text = (
        F.when(F.col("event_type") == "tool_result", stringified(_get(F.col("b"), "$.content", "variant"))).when(F.col("event_type") == "user_message", F.when(type_ == "text", F.coalesce(said, F.lit(""))).otherwise(other))
        .when(F.col("event_type") == "assistant_text", said).when(F.col("event_type") == "assistant_thinking", thought).when(F.col("event_type") == "tool_call", summary(tool, given))
        .when(F.col("kind") == "system", F.coalesce(_get(F.col("v"), "$.content"), F.lit(""))).otherwise(F.substring("raw", 1, 500))
    )
    call = F.col("event_type") == "tool_call"
    op = F.create_map(*[F.lit(x) for kv in (rules.EDIT_TOOLS | {"Read": "read"}).items() for x in kv])
    old = F.when(tool == "Edit", _get(given, "$.old_string")).when(tool == "NotebookEdit", _get(given, "$.old_source"))
    new = F.when(tool == "Edit", _get(given, "$.new_string")).when(tool == "Write", _get(given, "$.content")).when(tool == "NotebookEdit", _get(given, "$.new_source"))
    edits = F.when(tool == "MultiEdit", F.from_json(_get(given, "$.edits"), "array<struct<old_string:string,new_string:string,replace_all:boolean>>"))
    b = b.select(
        "path", "line_no", "offset", "event_type", F.size(F.coalesce("blocks", F.array().cast(BLOCK))).alias("n_blocks"), "kind",
        F.coalesce(_get(F.col("v"), "$.sessionId"), F.lit("")).alias("session_id"), _get(F.col("v"), "$.parentUuid").alias("parent_event_id"), _get(F.col("v"), "$.uuid").alias("uuid"),
        timestamp(F.coalesce(_get(F.col("v"), "$.timestamp"), _get(F.col("v"), "$.snapshot.timestamp"))).alias("ts"), _get(F.col("v"), "$.cwd").alias("cwd"), _get(F.col("v"), "$.gitBranch").alias("git_branch"),
        F.coalesce(_get(F.col("v"), "$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"), F.when(is_bot, _get(F.col("v"), "$.message.model")).alias("model"), text.alias("content"),
        F.when(call, tool).alias("tool_name"), F.when(call, _get(F.col("b"), "$.id")).when(F.col("event_type") == "tool_result", _get(F.col("b"), "$.tool_use_id")).alias("tool_use_id"),
        F.when(call, F.to_json(given)).alias("tool_input_json"), F.when(F.col("event_type") == "tool_result", _get(F.col("v"), "$.toolUseResult.success", "boolean")).alias("tool_success"),
        F.when(call, F.coalesce(_get(given, "$.file_path"), _get(given, "$.notebook_path"))).alias("file_path"), F.when(call, F.try_element_at(op, tool)).alias("file_operation"),
        F.when(call, old).alias("old_content"), F.when(call, new).alias("new_content"), F.when(call, edits).alias("edits"), F.when(call & (tool == "Edit"), F.coalesce(_get(given, "$.replace_all", "boolean"), F.lit(False))).alias("replace_all"), F.when(call, _get(given, "$.command")).alias("command"), "raw",
    )
    w = W.partitionBy("path").orderBy("line_no", "offset")
    b = b.withColumn("rn", F.row_number().over(w) - 1)
    if after is not None:
        b = b.join(after.select("path", F.col("events").alias("_before")), "path", "left").withColumn("rn", F.col("rn") + F.coalesce("_before", F.lit(0))).drop("_before")
    b = b.withColumn("base", F.min("rn").over(W.partitionBy("path", "line_no")))
    b = b.withColumn("sequence", (F.col("base") + F.col("offset")).cast("long"))
    prefix = F.when(is_user, "user-").when(is_bot, "asst-").when(F.col("kind") == "system", "sys-").otherwise("unk-")
    base_id = F.coalesce("uuid", F.concat(prefix, F.col("base").cast("string")))
    suffixed = (is_user & (F.col("offset") > 0)) | (is_bot & (F.col("n_blocks") > 1))
    b = b.withColumn("id0", F.when(suffixed, F.concat_ws(":", base_id, "offset")).otherwise(base_id))
    again = F.row_number().over(W.partitionBy("path", "id0").orderBy("line_no", "offset")) - 1
    b = b.withColumn("again", again).withColumn("event_id", F.when(F.col("again") > 0, F.concat_ws("#", "id0", "again")).otherwise(F.col("id0")))
    # results learn the tool and command of the last call before them
    known = W.partitionBy("path", "tool_use_id").orderBy("line_no", "offset").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("_call", F.when(F.col("event_type") == "tool_result", F.last(F.when(F.col("event_type") == "tool_call", F.struct("tool_name", "command")), True).over(known)))
    if calls is not None:
        earlier = calls.select("path", "tool_use_id", F.struct("tool_name", "command").alias("_earlier"))
        b = b.join(earlier, ["path", "tool_use_id"], "left").withColumn("_call", F.when(F.col("event_type") == "tool_result", F.coalesce("_call", "_earlier"))).drop("_earlier")
    result = F.col("event_type") == "tool_result"
    for name, column in gated_error(F.when(result, F.col("content")), F.col("_call.tool_name"), F.col("tool_success")).items():
        b = b.withColumn(name, column)
    git = F.when(result & F.col("_call.tool_name").isin(rules.COMMAND_TOOLS), git_signal(F.col("_call.command"), F.col("content")))
    b = b.withColumn("_git", git).withColumns({"git_operation": F.col("_git.operation"), "git_commit_hash": F.col("_git.commit_hash"), "git_commit_message": F.col("_git.message")})
    return b.withColumn("tool_output", F.when(result, F.col("content"))).drop("rn", "base", "id0", "again", "uuid", "kind", "n_blocks", "_call", "_git").withColumnsRenamed({"path": "transcript_path", "raw": "raw_json"})
