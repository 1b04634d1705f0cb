"""Where each project was left: commits, branch, sessions, episodes, segments and drift, with a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scoped import git_of_projects


def ago(at: Column, now: Column) -> Column:
    """A time as whole days, weeks, months or years before now; "unknown" for null."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    older = F.when(days < 30, many(F.floor(days / 7), "week")).when(days < 365, many(F.floor(days / 30), "month")).otherwise(many(F.floor(days / 365), "year"))
    return F.when(at.isNull(), "unknown").when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(older)


def _newest(df: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The newest n rows of each project with their rank; a partial top n comes before the exchange."""
    w = W.partitionBy("project_id").orderBy(F.desc(time), key)
    return df.where("project_id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """(project_id, name): structs of the columns by rank; each list is as short as the ranks."""
    return df.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias(name))


def project_status(projects: DataFrame, sessions: DataFrame, outcome: DataFrame, episodes: DataFrame, segments: DataFrame, operations: DataFrame, drifted: DataFrame, now: Column, commits: int = 20, most: int = 5) -> DataFrame:
    """One row a project: display_name, canonical_path, branch, last_outcome, stale_files, the lists commits, sessions, recent, unresolved and segments (structs that
    begin with rank, newest first, null where there are none), and narrative.

    sessions, episodes and segments have project_id.  The newest 2 * `most` episodes count: the first `most` are recent, those not resolved are unresolved, and a commit is linked to
    the oldest of them that it fixed.  operations: as of git_of_projects, with branch and message.  drifted: (project_id, stale_files).
    """
    known = _newest(episodes, "ended_at", "episode_id", 2 * most)
    by_hash = known.where("fix_commit_hash <> ''").groupBy("project_id", F.col("fix_commit_hash").alias("commit_hash")).agg(F.max_by(F.struct("episode_id", "fix_summary"), "rank").alias("linked"))
    ops = git_of_projects(operations, sessions, most=commits).join(by_hash, ["project_id", "commit_hash"], "left")
    c = _listed(ops.select("project_id", "rank", "event_id", "operation", "commit_hash", "message", "ts", "branch", F.col("linked.episode_id").alias("linked_episode_id"), F.col("linked.fix_summary").alias("linked_fix")), "commits", "event_id", "operation", "commit_hash", "message", "ts", "branch", "linked_episode_id", "linked_fix")
    s = _listed(_newest(sessions, "started_at", "session_id", most).join(outcome.select("session_id", "outcome"), "session_id", "left"), "sessions", "session_id", "started_at", "event_count", "outcome")
    e = _listed(known, "_known", "episode_id", "status", "ended_at", "problem_description", "fix_summary")
    g = _listed(_newest(segments, "ended_at", "segment_id", most), "segments", "segment_id", "segment_type", "topic", "ended_at")
    out = projects.select("project_id", "display_name", "canonical_path")
    for part in (c, s, e, g, drifted.select("project_id", "stale_files")):
        out = out.join(part, "project_id", "left")
    out = out.na.fill(0, ["stale_files"]).withColumns({
        "branch": F.col("commits")[0]["branch"], "last_outcome": F.col("sessions")[0]["outcome"], "recent": F.slice("_known", 1, most),
        "unresolved": F.slice(F.filter("_known", lambda x: x["status"] != "resolved"), 1, most),
    })
    return out.withColumn("narrative", narrative(now)).drop("_known")


def narrative(now: Column) -> Column:
    """The status as a text; parts without rows are left out, but for open problems."""
    fixes = F.filter(F.transform("recent", lambda x: F.trim(F.coalesce(x["fix_summary"], F.lit("")))), lambda t: t != "")
    last = F.col("sessions")[0]
    told = F.concat(F.lit("Outcome: **"), last["outcome"], F.lit("**"), F.coalesce(F.concat(F.lit(" · Last fix: "), F.substring(F.try_element_at(fixes, F.lit(1)), 1, 150)), F.lit("")))
    lines = lambda rows, one: F.array_join(F.transform(rows, one), "\n")
    when = lambda at: F.concat(F.lit(" ("), ago(at, now), F.lit(")"))
    hashed = F.slice(F.filter("commits", lambda x: F.trim(F.coalesce(x["commit_hash"], F.lit(""))) != ""), 1, 10)
    commit = lambda x: F.concat(F.lit("- `"), F.substring(x["commit_hash"], 1, 8), F.lit("` "), F.substring(F.coalesce(F.nullif(x["message"], F.lit("")), F.lit("no message")), 1, 80), when(x["ts"]), F.coalesce(F.concat(F.lit("\n  linked: "), F.nullif(F.substring(x["linked_fix"], 1, 80), F.lit(""))), F.lit("")))
    problem = lambda x: F.concat(F.lit("- "), F.substring(F.coalesce(F.nullif(x["problem_description"], F.lit("")), F.lit("unknown issue")), 1, 120), when(x["ended_at"]))
    topic = lambda x: F.concat(F.lit("- ["), x["segment_type"], F.lit("] "), F.substring(F.coalesce(x["topic"], F.lit("")), 1, 80), when(x["ended_at"]))
    head = lambda title, rows: F.concat(F.lit(f"### {title} ("), F.size(rows).cast("string"), F.lit(")\n"))
    some = lambda rows, text: F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, text)
    open_, segs = F.col("unresolved"), F.col("segments")
    return F.concat_ws(
        "\n\n",
        F.when(F.col("stale_files") > 0, F.concat(F.lit("Not up to date: "), F.col("stale_files").cast("string"), F.lit(" transcripts wait to be read"))),
        F.concat(F.lit("## "), "display_name", F.lit("\n`"), F.coalesce("canonical_path", F.lit("")), F.lit("`"), F.coalesce(F.concat(F.lit(" · branch: `"), F.nullif("branch", F.lit("")), F.lit("`")), F.lit(""))),
        some(F.col("sessions"), F.concat_ws("\n", F.lit("### Last session"), told, F.concat(ago(last["started_at"], now), F.lit(" · "), last["event_count"].cast("string"), F.lit(" events")))),
        some(hashed, F.concat(head("Recent commits", hashed), lines(hashed, commit))),
        F.coalesce(some(open_, F.concat(head("Known issues", open_), lines(open_, problem))), F.lit("### Known issues\nNone tracked.")),
        some(segs, F.concat(head("Recent work", segs), lines(segs, topic))),
        F.when(F.coalesce(F.size("commits"), F.lit(0)) + F.coalesce(F.size("sessions"), F.lit(0)) + F.coalesce(F.size("recent"), F.lit(0)) == 0, "_No history found for this project._"),
    )
