"""Relative dates and the text of a project's status."""

import os

import pytest
from pyspark.sql import functions as F

from tracelake.operators import status


def test_ago(spark):
    days = {0: "today", 1: "yesterday", 3: "3 days ago", 7: "1 week ago", 29: "4 weeks ago", 30: "1 month ago", 300: "10 months ago", 365: "1 year ago", 800: "2 years ago"}
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    df = spark.createDataFrame([(d,) for d in days], "d int").withColumn("at", F.timestamp_add("DAY", -F.col("d"), now))
    assert {r.d: r.t for r in df.select("d", status.ago(F.col("at"), now).alias("t")).collect()} == days
    assert spark.range(1).select(status.ago(F.lit(None).cast("timestamp"), now).alias("t")).first().t == "unknown"


def test_status(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    at = lambda df, *names: df.withColumns({c: F.col(c).cast("timestamp") for c in names})
    projects = frame([("p", "shop", "/srv/shop"), ("q", "bare", None)], "project_id string, display_name string, canonical_path string")
    sessions = at(frame([("s1", "p", "2024-05-30", 7), ("s2", "p", "2024-05-01", 3)], "session_id string, project_id string, started_at string, event_count long"), "started_at")
    outcome = frame([("s1", "fixed")], "session_id string, outcome string")
    episodes = at(frame([("e1", "p", "unresolved", "2024-05-31", "it breaks", "", None), ("e2", "p", "resolved", "2024-05-20", "old", "mended it", "abc123456")], "episode_id string, project_id string, status string, ended_at string, problem_description string, fix_summary string, fix_commit_hash string"), "ended_at")
    segments = at(frame([("g1", "p", "design", "a plan", "2024-05-31")], "segment_id string, project_id string, segment_type string, topic string, ended_at string"), "ended_at")
    ops = at(frame([("x1", "s1", "2024-05-30", "commit", "abc123456", "", "main"), ("x2", "s1", "2024-05-29", "commit", "", "lost", "old")], "event_id string, session_id string, ts string, operation string, commit_hash string, message string, branch string"), "ts")
    drifted = frame([("p", 2)], "project_id string, stale_files int")
    now = F.lit("2024-06-01").cast("timestamp")
    got = {r.project_id: r for r in status.project_status(projects, sessions, outcome, episodes, segments, ops, drifted, now).collect()}
    p, q = got["p"], got["q"]
    assert (p.branch, p.last_outcome, p.stale_files) == ("main", "fixed", 2) and [x.event_id for x in p.commits] == ["x1"] and p.commits[0].linked_episode_id == "e2"
    assert [x.episode_id for x in p.unresolved] == ["e1"] and [x.episode_id for x in p.recent] == ["e1", "e2"]
    assert p.narrative.split("\n\n") == [
        "Not up to date: 2 transcripts wait to be read", "## shop\n`/srv/shop` · branch: `main`", "### Last session\nOutcome: **fixed** · Last fix: mended it\n2 days ago · 7 events",
        "### Recent commits (1)\n- `abc12345` no message (2 days ago)\n  linked: mended it", "### Known issues (1)\n- it breaks (yesterday)", "### Recent work (1)\n- [design] a plan (yesterday)",
    ]
    assert q.narrative == "## bare\n``\n\n### Known issues\nNone tracked.\n\n_No history found for this project._" and q.commits is None


def test_status_derives_events_once(spark):
    """The joined parts read the stored events, not the table each for itself."""
    from tracelake.plans import further

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the given tables are not here")
    files = further.j10_project_status(spark, sf).inputFiles()
    assert files and not [f for f in files if f.endswith("/events.parquet")]

