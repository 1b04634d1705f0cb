"""Searches, look-ups and views that hold to a project, a session or a kind of row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .pairing import context
from .query import latest
from .recall import newest_in_range
from .replay import file_states
from .search import nearest, nearest_within


def git_of_projects(operations: DataFrame, sessions: DataFrame, kind: str | None = None, most: int = 20) -> DataFrame:
    """The newest git operations of each project's sessions, commits without a hash left out.

    operations: session_id, event_id, ts, operation, commit_hash and others; sessions: session_id, project_id.
    """
    ops = operations.where((F.col("operation") != "commit") | (F.coalesce("commit_hash", F.lit("")) != ""))
    ops = ops if kind is None else ops.where(F.col("operation") == kind)
    joined = ops.join(sessions.where("project_id is not null").select("session_id", "project_id"), "session_id")
    w = W.partitionBy("project_id").orderBy(F.desc("ts"), "event_id")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def linked_commits(operations: DataFrame, episodes: DataFrame) -> DataFrame:
    """Operations with the episode that their commit fixed (null without one); of several with one hash, the one that ended first."""
    by_hash = episodes.where("fix_commit_hash is not null").groupBy(F.col("fix_commit_hash").alias("commit_hash")).agg(F.min_by("episode_id", F.struct("ended_at", "episode_id")).alias("linked_episode_id"))
    return operations.join(by_hash, "commit_hash", "left")


def sessions_of_projects(projects: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(project_id, session_id): the linked sessions of each project and, for projects without one, sessions with events on files below its path.

    A file is joined by equality through its own folders, so projects and files never meet all with all.
    """
    linked = sessions.where("project_id is not null").select("project_id", "session_id").distinct()
    bare = projects.select("project_id", "canonical_path").join(linked.select("project_id").distinct(), "project_id", "left_anti")
    parts = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    files = events.where("file_path is not null").select("session_id", "file_path").distinct()
    below = files.select("session_id", F.explode(folders).alias("canonical_path")).distinct()
    return linked.union(below.join(bare, "canonical_path").select("project_id", "session_id").distinct())


def in_project(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits (with project_id and session_id) whose session is the project's; null projects keep all."""
    return hits.where("project_id is null").unionByName(hits.join(members.select("project_id", "session_id"), ["project_id", "session_id"], "left_semi").select(hits.columns))


def enriched(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Hits with the row they stand for; hits without one are dropped."""
    return hits.join(rows, key)


def looked_up(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of any table whose key is asked for."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def merged_hits(first: DataFrame, second: DataFrame, key: str, most: int) -> DataFrame:
    """Two hit lists of each question (query_id, key, rank) as one; a row in both counts once, at its place in the first list."""
    both = first.select("query_id", key, "rank", F.lit(0).alias("list")).unionByName(second.select("query_id", key, "rank", F.lit(1).alias("list")))
    place = both.groupBy("query_id", key).agg(F.min(F.struct("list", "rank")).alias("place"))
    w = W.partitionBy("query_id").orderBy("place", key)
    return place.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", key, "rank")


def search_sessions(sessions: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nearest sessions by vector; a question's project_id (or null) and since / until hold first."""
    return nearest(sessions, queries, k, key="session_id", equal=["project_id"], during="started_at")


def search_projects(projects: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nearest projects by vector; a question's category (or null) holds first."""
    return nearest(projects, queries, k, key="project_id", equal=["category"])


def search_episodes(episodes: DataFrame, queries: DataFrame, k: int, has_fix: bool | None = None) -> DataFrame:
    """Nearest episodes by vector; a question's project_id (or null), since / until and has_fix hold first."""
    some = episodes if has_fix is None else episodes.where(F.col("fix_event_id").isNotNull() == has_fix)
    return nearest(some, queries, k, key="episode_id", equal=["project_id"], during="ended_at")


def find_episodes(queries: DataFrame, episodes: DataFrame, k: int, has_fix: bool = True, status: str | None = None, keyword: str | None = None) -> DataFrame:
    """(query_id, episode_id, distance, rank): the nearest episodes in a question's projects (array or null) and range that pass the filters;
    for questions without a vector, or without any hit, the newest such episodes, whose distance is null.

    All filters hold before the k are chosen, so none of them can leave a question short.
    """
    some = episodes.where("fix_event_id is not null") if has_fix else episodes
    some = some if status is None else some.where(F.col("status") == status)
    if keyword:
        low = F.lower(F.concat_ws(" ", "problem_description", "diagnosis_summary", "fix_summary"))
        some = some.where(F.contains(low, F.lit(keyword.lower())))
    near = nearest(some, queries, k, key="episode_id", during="ended_at", among=("project_id", "projects"))
    newest = newest_in_projects(some, queries.join(near, "query_id", "left_anti"), k)
    return near.select("query_id", "episode_id", "distance", "rank").unionByName(newest.select("query_id", "episode_id", F.lit(None).cast("double").alias("distance"), "rank"))


def newest_in_projects(episodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The newest k episodes in each question's range and projects (an array; null, empty or with a null in it: all of them): (query_id, episode_id, rank).

    Episodes are joined by project, and each different project and range is answered once; questions share the answers.
    """
    t = lambda c: F.col(c).cast("timestamp")
    every = F.coalesce(F.size("projects") == 0, F.lit(True)) | F.coalesce(F.exists("projects", lambda p: p.isNull()), F.lit(False))
    q = queries.select("query_id", t("since").alias("since"), t("until").alias("until"), "projects", every.alias("every"))
    free = newest_in_range(episodes, q.where("every"), k).select("query_id", "episode_id", "rank")
    wanted = q.where("not every").select("query_id", "since", "until", F.explode(F.array_distinct("projects")).alias("project_id"))
    inside = (F.col("since").isNull() | (t("ended_at") >= F.col("since"))) & (F.col("until").isNull() | (t("ended_at") <= F.col("until")))
    found = episodes.select("episode_id", "project_id", "ended_at").join(wanted.select("project_id", "since", "until").distinct(), "project_id").where(inside)
    order = (F.desc("ended_at"), "episode_id")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("project_id", "since", "until").orderBy(*order))).where(F.col("r") <= k)
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"top.{c}")) for c in ("project_id", "since", "until")]
    of = wanted.alias("q").join(top.alias("top"), same[0] & same[1] & same[2]).select("query_id", "episode_id", "ended_at").distinct()
    mine = of.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return free.unionByName(mine.select("query_id", "episode_id", "rank"))


def episode_events(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """The four events of each episode: its id and, for problem, diagnosis, fix and verification, that event's type, tool, time and text (null where there is none).  One join brings all four."""
    roles = ["problem", "diagnosis", "fix", "verification"]
    asked = episodes.select("episode_id", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_event_id").alias("event_id")) for r in roles]))).where("event_id is not null")
    shown = events.select("event_id", F.struct("event_type", "tool_name", "ts", "content").alias("e"))
    pick = lambda r, c: F.max(F.when(F.col("role") == r, F.col(f"e.{c}"))).alias(f"{r}_{c}")
    cols = [pick(r, c) for r in roles for c in ("event_type", "tool_name", "ts", "content")]
    got = asked.join(shown, "event_id").groupBy("episode_id").agg(*cols)
    return episodes.select("episode_id").join(got, "episode_id", "left")


def find_segments(queries: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """The nearest segments in a question's projects and range, with their rows."""
    near = nearest(segments, queries, k, key="segment_id", during="started_at", among=("project_id", "projects"))
    return enriched(near, segments.drop("vector"), "segment_id")


def scoped_events(queries: DataFrame, best: DataFrame, members: DataFrame, events: DataFrame, k: int, least: float = 0.8) -> DataFrame:
    """Nearest events for each question, in the sessions of the project that it names.

    best: (query_id, project_id, score), the top match of each question; only scores of `least` or more scope it.  members:
    (project_id, session_id).  Returns query_id, event_id, distance, rank and scoped_to.
    """
    top = best.where(F.col("score") >= least).groupBy("query_id").agg(F.max_by("project_id", F.struct("score", "project_id")).alias("project_id"))
    asked = queries.join(top, "query_id", "left")
    of = members.select("project_id", "session_id")
    scoped = nearest_within(events.join(of, "session_id"), asked.where("project_id is not null"), k, key="event_id", group="project_id")
    free = nearest(events, asked.where("project_id is null"), k, key="event_id")
    got = scoped.select("query_id", "event_id", "distance", "rank").unionByName(free.select("query_id", "event_id", "distance", "rank"))
    return got.join(top.select("query_id", F.col("project_id").alias("scoped_to")), "query_id", "left")


def search_in_context(queries: DataFrame, events: DataFrame, vectors: DataFrame, k: int, reach: int) -> DataFrame:
    """Events around the nearest ones of each question's own session: (query_id, session_id, sequence, event_id, is_match).  queries: query_id, session_id (null: any), vector; vectors: event_id, session_id, vector."""
    near = nearest_within(vectors, queries, k, key="event_id", group="session_id").unionByName(nearest(vectors, queries.where("session_id is null"), k, key="event_id"))
    hits = near.select("query_id", "event_id").join(events.select("event_id", "session_id", "sequence"), "event_id")
    name = F.concat_ws("\x1f", "query_id", "session_id")  # windows merge inside one question and session
    mine = hits.select(name.alias("session_id"), "sequence")
    of = hits.select("query_id", "session_id").distinct().join(events.select("session_id", "sequence", "event_id"), "session_id")
    around = context(of.select(name.alias("session_id"), "sequence", "event_id", "query_id", F.col("session_id").alias("own")), mine, reach)
    return around.select("query_id", F.col("own").alias("session_id"), "sequence", "event_id", "is_match")


def artifacts(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """What belongs to each episode: the fix's file and both sides, the file as it was right after, and the diagnosis."""
    fix = events.select(F.col("event_id").alias("fix_event_id"), "session_id", "file_path", "tool_name", "sequence", F.coalesce("old_content", F.lit("")).alias("old"), F.coalesce("new_content", F.lit("")).alias("new"))
    fixed = episodes.select("episode_id", "fix_event_id").join(fix, "fix_event_id")
    states = file_states(events, fixed.select("session_id", "file_path", F.col("sequence").alias("until")).distinct()).select("session_id", "file_path", F.col("until").alias("sequence"), F.col("content").alias("file_state_after"))
    said = events.select(F.col("event_id").alias("diagnosis_event_id"), F.col("content").alias("diagnosis"))
    whole = fixed.join(states, ["session_id", "file_path", "sequence"], "left").drop("session_id", "sequence", "fix_event_id")
    return episodes.select("episode_id", "diagnosis_event_id").join(whole, "episode_id", "left").join(said, "diagnosis_event_id", "left").drop("diagnosis_event_id")


def relevance(query: Column, *texts: str) -> Column:
    """Distinct words of the question (4 letters or more) that the texts hold, and twice the confidence."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z]{4,}"), F.lit(0)))
    low = F.lower(F.concat_ws(" ", *texts))
    return F.size(F.filter(words, lambda w: F.contains(low, w))) + 2 * F.coalesce("confidence", F.lit(0.0))


def context_blocks(best: DataFrame, queries: DataFrame, least: float = 3.0, shortest: int = 10) -> DataFrame:
    """(query_id, relevance, block): past context worth showing; questions below `shortest` characters or `least` relevance get none.  best: the top episode of each question, with its texts."""
    q = queries.where(F.length("query") >= shortest).select("query_id", "query")
    c = best.where("rank = 1").join(q, "query_id")
    c = c.withColumn("relevance", F.round(relevance(F.col("query"), "problem_description", "diagnosis_summary", "fix_summary"), 6)).where(F.col("relevance") >= least)
    part = lambda label, name, n: F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), F.trim(F.substring(name, 1, n))))
    found = F.concat(F.lit("Found in session "), F.substring("session_id", 1, 8), F.lit(" at "), F.date_format("ended_at", "yyyy-MM-dd HH:mm"))
    return c.select("query_id", "relevance", F.concat_ws("\n\n", found, part("Problem", "problem_description", 300), part("Diagnosis", "diagnosis_summary", 400), part("Fix", "fix_summary", 300)).alias("block"))


def to_continue(events: DataFrame, episodes: DataFrame, n: int = 10, open_: int = 3) -> DataFrame:
    """Where each session was left: its last n events (no thinking, snapshots or system rows) and its newest unresolved problems."""
    shown = events.where(~F.col("event_type").isin("assistant_thinking", "file_snapshot", "system"))
    line = F.concat_ws(" ", "event_type", "tool_name", F.substring(F.trim("content"), 1, 400))
    last = latest(shown, n).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", line.alias("t")))), lambda x: x["t"]).alias("last_events"))
    w = W.partitionBy("session_id").orderBy(F.desc("ended_at"), "episode_id")
    left = episodes.where("status = 'unresolved'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= open_)
    left = left.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("problem_description", 1, 100).alias("t")))), lambda x: x["t"]).alias("unresolved"))
    return last.join(left, "session_id", "left").withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))


def without_vectors(texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Texts that have no vector yet: what a backfill embeds."""
    return texts.join(vectors.select(key), key, "left_anti")


def classified_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """(transcript_path, bucket): each file as missing from sessions, without a project, or complete."""
    known = sessions.groupBy("transcript_path").agg(F.max("project_id").alias("project_id"), F.lit(True).alias("known"))
    bucket = F.when(F.col("known").isNull(), "missing").when(F.col("project_id").isNull(), "no_project").otherwise("complete")
    return files.join(known, "transcript_path", "left").select("transcript_path", bucket.alias("bucket"))


def to_reingest(lines: DataFrame, files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Lines (path, ...) of the files that a reconcile must parse again: those without a session or without a project."""
    again = classified_files(files, sessions).where("bucket <> 'complete'").select(F.col("transcript_path").alias("path"))
    return lines.join(again, "path", "left_semi")
