"""Look-ups over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.extract import holds


def list_sessions(sessions: DataFrame, outcome: DataFrame | None = None, kind: str | None = None, path: str | None = None, since=None, until=None, limit: int = 50, offset: int = 0) -> DataFrame:
    out = sessions
    if path:
        out = out.where(holds(F.col("cwd"), F.lit(path)))
    if since is not None:
        out = out.where(F.col("started_at") >= since)
    if until is not None:
        out = out.where(F.col("started_at") <= until)
    if outcome is not None:
        out = out.join(outcome.select("session_id", "outcome"), "session_id", "inner" if kind else "left")
        if kind:
            out = out.where(F.col("outcome") == kind)
    return out.orderBy(F.desc("started_at"), "session_id").offset(offset).limit(limit)


def get_events(events: DataFrame, hide_repeats: bool = True, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    out = events.where(~F.contains("event_id", F.lit("#"))) if hide_repeats else events
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out.orderBy("ts", "sequence", "event_id").offset(offset).limit(limit)


def sequence_range(events: DataFrame, low: int, high: int) -> DataFrame:
    return events.where(F.col("sequence").between(low, high) & ~F.contains("event_id", F.lit("#")))


def latest(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each session; partial top n before the exchange."""
    w = W.partitionBy("session_id").orderBy(F.desc("sequence"), "event_id")
    return events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def timeline(events: DataFrame, tail: int, thinking: bool = True) -> DataFrame:
    shown = events.where(~F.startswith("event_id", F.lit("unk")))
    shown = shown if thinking else shown.where("event_type <> 'assistant_thinking'")
    return latest(shown, tail).select("session_id", "sequence", "event_id", "event_type", F.substring("content", 1, 200).alias("shown"))


def by_prefix(sessions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, session_id): the newest session that starts with the prefix.  Sessions are exploded to their heads of every length that a prefix has, so the join is by equality."""
    lengths = prefixes.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))  # one row, as long as the longest prefix at most
    heads = sessions.crossJoin(F.broadcast(lengths)).select("session_id", "started_at", F.explode(F.filter("lengths", lambda n: n <= F.length("session_id"))).alias("n"))
    heads = heads.withColumn("prefix", F.substring(F.col("session_id"), F.lit(1), F.col("n")))
    return heads.join(prefixes.select("prefix").distinct(), "prefix").groupBy("prefix").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"))


def find_git(operations: DataFrame, part: str) -> DataFrame:
    return operations.where(holds(F.col("message"), F.lit(part)) | holds(F.col("commit_hash"), F.lit(part)) | holds(F.col("branch"), F.lit(part)))


def _among(df: DataFrame, time: str, projects: list[str] | None, session: str | None, since, until) -> DataFrame:
    if projects is not None:
        df = df.where(F.col("project_id").isin(projects))
    if session is not None:
        df = df.where(F.col("session_id") == session)
    if since is not None:
        df = df.where(F.col(time) >= since)
    return df if until is None else df.where(F.col(time) <= until)


def query_episodes(episodes: DataFrame, status: str | None = None, keyword: str | None = None, has_fix: bool | None = None, limit: int = 20, projects: list[str] | None = None, session: str | None = None, since=None, until=None) -> DataFrame:
    """Filters come before the limit; the range is of ended_at.  projects needs a project_id column."""
    out = _among(episodes, "ended_at", projects, session, since, until)
    if status:
        out = out.where(F.col("status") == status)
    if has_fix is not None:
        out = out.where(F.col("fix_event_id").isNotNull() == has_fix)
    if keyword:
        k = F.lit(keyword)
        out = out.where(holds(F.col("problem_description"), k) | holds(F.col("diagnosis_summary"), k) | holds(F.col("fix_summary"), k))
    return out.orderBy(F.desc("ended_at"), "episode_id").limit(limit)


def query_segments(segments: DataFrame, kind: str | None = None, keyword: str | None = None, limit: int = 20, projects: list[str] | None = None, session: str | None = None, since=None, until=None) -> DataFrame:
    """Filters come before the limit; the range is of ended_at.  projects needs a project_id column."""
    out = _among(segments, "ended_at", projects, session, since, until)
    out = out if kind is None else out.where(F.col("segment_type") == kind)
    if keyword:
        out = out.where(holds(F.col("topic"), F.lit(keyword)) | holds(F.col("summary"), F.lit(keyword)))
    return out.orderBy(F.desc("ended_at"), "segment_id").limit(limit)


def reconciled(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """(bucket, files): missing from sessions, without a project, complete."""
    got = files.join(sessions.select("transcript_path", "project_id", F.lit(True).alias("known")), "transcript_path", "left")
    bucket = F.when(F.col("known").isNull(), "missing").when(F.col("project_id").isNull(), "no_project").otherwise("complete")
    return got.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("files"))


def recall_diff(before: DataFrame, after: DataFrame, top: int = 5) -> DataFrame:
    """Changes between two result tables (query_id, id, rank, distance) in their first `top` ranks."""
    key = ["query_id", "rank"]
    a = before.where(F.col("rank") <= top).select(*key, F.col("id").alias("before"), F.col("distance").alias("d0"))
    b = after.where(F.col("rank") <= top).select(*key, F.col("id").alias("after"), F.col("distance").alias("d1"))
    return a.join(b, key, "full_outer").where("not (before <=> after) or abs(d0 - d1) > 1e-6")


def episode_markdown(episodes: DataFrame) -> DataFrame:
    """(episode_id, markdown) documents."""
    part = lambda h, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"## {h}\n"), F.col(c)))
    head = F.concat(F.lit("# "), F.col("episode_id"), F.lit(" ("), F.col("status"), F.lit(")"))
    return episodes.select("episode_id", F.concat_ws("\n\n", head, part("Problem", "problem_description"), part("Diagnosis", "diagnosis_summary"), part("Fix", "fix_summary")).alias("markdown"))
