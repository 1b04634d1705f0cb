"""Sessions: roll-ups, outcomes, statistics, patterns and recaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from .pairing import in_order

EPOCH = "1970-01-01"


def _count(cond: Column | str) -> Column:
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond)


def rollup(events: DataFrame) -> DataFrame:
    """One row a session: counts by kind, first and last time that is not the epoch, first cwd, most frequent model (ties: first seen)."""
    real = F.when(F.col("ts") > F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts"))
    base = events.groupBy("session_id").agg(
        F.min(real).alias("started_at"), F.max(real).alias("ended_at"), F.count(F.lit(1)).alias("event_count"), _count("event_type = 'user_message'").alias("user_message_count"),
        _count("event_type = 'assistant_text'").alias("assistant_message_count"), _count("event_type = 'tool_call'").alias("tool_call_count"),
        _count(F.col("file_operation").isin(rules.EDITS)).alias("file_edit_count"), F.min_by("cwd", F.when(F.col("cwd") != "", F.col("sequence"))).alias("cwd"),
    )
    models = events.where("model is not null").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("at"))
    model = models.groupBy("session_id").agg(F.max_by("model", F.struct("n", -F.col("at"))).alias("model"))
    return base.join(model, "session_id", "left")


def live_rollup(events: DataFrame) -> DataFrame:
    """The cheaper roll-up of a growing session: any assistant event counts, cwd and model are the largest."""
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), _count("event_type = 'user_message'").alias("user_message_count"),
        _count("event_type like 'assistant%'").alias("assistant_message_count"), _count("event_type = 'tool_call'").alias("tool_call_count"), F.max("cwd").alias("cwd"), F.max("model").alias("model"),
    )


def best_root(events: DataFrame, roots: DataFrame, home: str, most: int = 20) -> DataFrame:
    """(session_id, project_path): the most common resolved root of its events.  roots: (cwd, root).  Only the
    first `most` distinct cwds of a session are resolved; the home folder never counts; ties: first seen."""
    by_cwd = events.where("cwd is not null and cwd <> ''").groupBy("session_id", "cwd").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("at"))
    early = by_cwd.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy("at"))).where(F.col("r") <= most)
    known = early.join(roots, "cwd").where(F.col("root").isNotNull() & (F.col("root") != home))
    total = known.groupBy("session_id", "root").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    return total.groupBy("session_id").agg(F.max_by("root", F.struct("n", -F.col("at"))).alias("project_path"))


def outcomes(events: DataFrame) -> DataFrame:
    """fixed, stuck, shipped, exploratory or abandoned, by one aggregation a session.

    Fixed: some clean result after the first error; the last such result resolves it.
    """
    w = in_order()
    flat = events.withColumns({"idx": F.row_number().over(w) - 1, "is_error": (F.col("event_type") == "tool_result") & F.col("error_detected")})
    flat = flat.withColumn("first_error", F.min(F.when(F.col("is_error"), F.col("idx"))).over(W.partitionBy("session_id")))
    clean = (F.col("event_type") == "tool_result") & ~F.col("error_detected")
    low = F.lower("content")
    passed = clean & (low.contains("passed") | low.contains("✓") | low.contains("ok") | low.contains("success")) & low.contains("test")
    after = F.when(clean & (F.col("idx") > F.col("first_error")), F.col("idx"))
    edit = (F.col("event_type") == "tool_call") & F.col("file_operation").isin(rules.EDITS)
    got = flat.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), _count("is_error").alias("error_count"), _count(edit).alias("fix_count"), _count("event_type = 'tool_call' and file_operation = 'read'").alias("reads"),
        _count(passed).alias("test_pass_count"), _count(F.col("is_error") & (F.col("error_category") == "test")).alias("test_fail_count"),
        F.min_by("event_id", F.when(F.col("is_error"), F.col("idx"))).alias("first_error_event_id"), F.max(after).alias("at"), F.max_by("event_id", after).alias("resolution_event_id"),
        F.min_by("content", F.when(F.col("event_type") == "user_message", F.col("idx"))).alias("ask"),
    )
    edits, errors = F.col("fix_count"), F.col("error_count") > 0
    kind = (
        F.when(errors & F.col("at").isNotNull(), "fixed").when(errors, "stuck").when(edits >= 3, "shipped").when(F.col("reads") > 2 * edits, "exploratory")
        .when(F.col("n") < 5, "abandoned").when(edits > 0, "shipped").otherwise("exploratory")
    )
    sure = (
        F.when(errors & F.col("at").isNotNull(), 0.7 + F.least(F.lit(0.3), F.col("at") / F.col("n") * 0.3)).when(errors, 0.6).when(edits >= 3, 0.75)
        .when(F.col("reads") > 2 * edits, 0.8).when(F.col("n") < 5, 0.5).otherwise(0.55)
    )
    text = F.trim(F.concat("outcome", F.lit(": "), F.substring(F.coalesce("ask", F.lit("")), 1, 200)))
    out = got.withColumns({"outcome": kind, "confidence": F.round(sure, 6)}).withColumn("summary", F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text))
    return out.select("session_id", "outcome", "confidence", "error_count", "fix_count", "test_pass_count", "test_fail_count", "first_error_event_id", "resolution_event_id", "summary")


def session_text(events: DataFrame, outcome: DataFrame, roots: DataFrame, projects: DataFrame) -> DataFrame:
    """(session_id, project_id, started_at, text) to embed: project, first question, outcome and files.  roots: (session_id, project_id)."""
    asked = F.when((F.col("event_type") == "user_message") & (F.trim("content") != ""), F.col("sequence"))
    s = events.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.min_by(F.trim("content"), asked).alias("ask"), F.array_sort(F.collect_set("file_path")).alias("files"))
    s = s.join(outcome.select("session_id", "outcome", "summary"), "session_id", "left").join(roots, "session_id", "left").join(projects.select("project_id", "display_name", "category", "keywords"), "project_id", "left")
    say = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    some = lambda label, c, n: F.when(F.size(c) > 0, say(label, F.array_join(F.slice(c, 1, n), ", ")))
    text = F.concat_ws(" | ", say("Project", F.col("display_name")), say("Category", F.col("category")), some("Keywords", "keywords", 10), say("Asked", F.substring("ask", 1, 300)), say("Outcome", F.col("outcome")), say("Summary", F.substring("summary", 1, 300)), some("Files", "files", 10))
    return s.select("session_id", "project_id", "started_at", text.alias("text"))


def statistics(events: DataFrame, outcome: DataFrame, episodes: DataFrame | None = None, segments: DataFrame | None = None, projects: DataFrame | None = None, operations: DataFrame | None = None) -> DataFrame:
    """(name, value) counts over the tables, each table read once; those of tables not given are left out."""
    n = F.count(F.lit(1))
    a = events.agg(
        n.alias("events"), F.count_distinct("session_id").alias("sessions"), _count("event_type = 'tool_call'").alias("tool_calls"), _count("event_type = 'assistant_thinking'").alias("thinking_blocks"),
        _count((F.col("event_type") == "tool_call") & F.col("file_operation").isin(rules.EDITS)).alias("file_edits"), _count("error_detected").alias("errors"),
    )
    parts = [a, outcome.agg(n.alias("outcomes"), _count("outcome = 'fixed'").alias("fixed_sessions"), _count("outcome = 'stuck'").alias("stuck_sessions"))]
    if episodes is not None:
        parts.append(episodes.agg(n.alias("episodes"), _count("status = 'resolved'").alias("resolved_episodes")))
    if segments is not None:
        parts.append(segments.agg(n.alias("segments")))
    if projects is not None:
        parts.append(projects.agg(n.alias("projects")))
    if operations is not None:
        parts.append(operations.agg(n.alias("git_operations"), _count("operation = 'commit'").alias("git_commits")))
    long = [p.unpivot([], p.columns, "name", "value") for p in parts]
    out = long[0]
    for p in long[1:]:
        out = out.unionByName(p)
    return out


def patterns(episodes: DataFrame, least: int, top: int) -> DataFrame:
    """Recurring problems: (first tag or "unknown", longest distinctive word of the problem or "general") with at least `least`
    episodes, three different examples of 120 characters (the newest first) and the newest fix."""
    words = F.filter(F.regexp_extract_all(F.lower(F.substring("problem_description", 1, 300)), F.lit(r"[a-z][a-z0-9]{4,}"), F.lit(0)), lambda x: ~x.isin(rules.PATTERN_STOPWORDS))
    word = F.transform(F.array_sort(F.transform(words, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    keyed = episodes.select("episode_id", "ended_at", "problem_description", "fix_summary", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("unknown")).alias("tag"), F.coalesce(F.try_element_at(word, F.lit(1)), F.lit("general")).alias("word"))
    place = F.struct("ended_at", "episode_id")
    n = keyed.groupBy("tag", "word").agg(F.count(F.lit(1)).alias("n"), F.max_by("fix_summary", F.when(F.coalesce("fix_summary", F.lit("")) != "", place)).alias("fix")).where(F.col("n") >= least)
    best = n.orderBy(F.desc("n"), "tag", "word").limit(top)
    shown = keyed.where(F.trim("problem_description") != "").withColumn("head", F.lower(F.substring("problem_description", 1, 60)))
    shown = shown.groupBy("tag", "word", "head").agg(F.max(F.struct("ended_at", "episode_id", F.trim(F.substring("problem_description", 1, 120)).alias("text"))).alias("e"))
    w = W.partitionBy("tag", "word").orderBy(F.desc("e.ended_at"), F.desc("e.episode_id"))
    three = shown.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("tag", "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "e.text"))), lambda x: x["text"]).alias("examples"))
    return best.join(three, ["tag", "word"], "left")


def recap(sessions: DataFrame, outcome: DataFrame, events: DataFrame, since, projects: DataFrame | None = None, episodes: DataFrame | None = None) -> DataFrame:
    """Recent sessions with outcome and the first of their first 3 messages that is no markup.

    projects (project_id, display_name), for sessions with project_id, and episodes (session_id, status) add the project's
    name and how many of the session's episodes there are and are resolved.
    """
    msg = events.where("event_type = 'user_message'").withColumn("r", F.row_number().over(in_order())).where("r <= 3 and not startswith(content, '<')")
    first = msg.groupBy("session_id").agg(F.min_by("content", "r").alias("first_message"))
    recent = sessions.where(F.col("started_at") >= since)
    out = recent.select("session_id", "started_at", *(["project_id"] if projects is not None else [])).join(outcome.select("session_id", "outcome"), "session_id", "left").join(first, "session_id", "left")
    if projects is not None:
        out = out.join(projects.select("project_id", F.col("display_name").alias("project")), "project_id", "left").drop("project_id")
    if episodes is not None:
        n = episodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("episodes"), _count("status = 'resolved'").alias("resolved"))
        out = out.join(n, "session_id", "left").na.fill(0, ["episodes", "resolved"])
    return out


def freshness(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Share of files with a sessions row: green (all), yellow (half), red."""
    hit = files.join(sessions.select("transcript_path").distinct().withColumn("known", F.lit(True)), "transcript_path", "left")
    got = hit.agg(F.count(F.lit(1)).alias("files"), F.round(F.coalesce(F.avg(F.when(F.col("known"), 1.0).otherwise(0.0)), F.lit(1.0)), 6).alias("ratio"))
    return got.withColumn("status", F.when(F.col("ratio") >= 0.95, "green").when(F.col("ratio") >= 0.5, "yellow").otherwise("red"))


def unanalysed(sessions: DataFrame, outcome: DataFrame) -> DataFrame:
    return sessions.join(outcome, "session_id", "left_anti").agg(F.count(F.lit(1)).alias("unanalysed"))
