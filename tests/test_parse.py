"""Entries to events on transcripts of the usual shapes."""

import json
import pathlib
import tempfile

import pytest

from tracelake import parse
from tracelake.operators import episodes, pairing, replay, sessions
from tracelake.sources.jsonl import read_lines


def entry(kind, n, content=None, **more):
    e = {"type": kind, "uuid": f"{kind[0]}{n}", "sessionId": "s1", "timestamp": f"2024-03-01T10:00:{n:02d}Z", "cwd": "/w", "gitBranch": "main"}
    if content is not None:
        e["message"] = {"role": kind, "content": content} | ({"model": "m"} if kind == "assistant" else {})
    return e | more


BASIC = [
    {"type": "file-history-snapshot", "messageId": "x", "snapshot": {"timestamp": "2024-03-01T10:00:00Z"}},
    entry("user", 1, "fix auth"),
    entry("assistant", 2, [{"type": "thinking", "thinking": "look at auth.py and KeyError more closely now"}, {"type": "text", "text": "I will change auth.py so that it works again."}, {"type": "tool_use", "id": "t0", "name": "Bash", "input": {"command": "pytest"}}]),
    entry("user", 3, [{"type": "tool_result", "tool_use_id": "t0", "content": "Traceback (most recent call last):\n/w/auth.py: KeyError"}]),
    entry("assistant", 4, [{"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/auth.py", "old_string": "a", "new_string": "b"}}]),
    entry("user", 5, [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "done"}, {"type": "text", "text": "ok"}]}], toolUseResult={"success": True}),
    entry("user", 6, [{"type": "text", "text": "see"}, {"type": "image", "source": {"media_type": "image/png"}}]),
    entry("assistant", 7, [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "git commit -m x"}}]),
    entry("user", 8, [{"type": "tool_result", "tool_use_id": "t2", "content": "[main abc1234] x"}]),
    entry("queue-operation", 9),
    entry("user", 6, "again"),
    {"type": "odd", "sessionId": "s1"},
]


@pytest.fixture(scope="module")
def events(spark):
    d = pathlib.Path(tempfile.mkdtemp(prefix="spark-t-"))  # pytest's own folder names are left out by the listing
    lines = [json.dumps(e) for e in BASIC]
    (d / "a.jsonl").write_text("\n".join([*lines[:2], "", "not json", *lines[2:]]) + "\n")
    (d / "skill-injections.jsonl").write_text(lines[1] + "\n")
    return parse.events(read_lines(spark, str(d))).cache()


def test_events(events):
    rows = events.orderBy("line_no", "offset").collect()
    assert [r.event_type for r in rows] == ["file_snapshot", "user_message", "assistant_thinking", "assistant_text", "tool_call", "tool_result", "tool_call", "tool_result", "user_message", "user_message", "tool_call", "tool_result", "user_message", "unknown"]
    by = {r.event_id: r for r in rows}
    assert {"u1", "a2:0", "a2:1", "a2:2", "u3", "a4", "u5", "u6", "u6:1", "u6#1"} <= set(by)
    assert by["u6:1"].content == "[image: image/png]" and by["u5"].content == "done\nok" and by["u5"].tool_success is True
    assert by["u3"].error_detected and by["u3"].error_category == "python" and not by["u5"].error_detected
    assert by["u8"].git_operation == "commit" and by["u8"].git_commit_hash == "abc1234"
    assert (by["a4"].file_path, by["a4"].file_operation, by["a4"].old_content, by["a4"].new_content) == ("/w/auth.py", "edit", "a", "b")
    assert by["a2:2"].content == "Tool: Bash\ncommand: pytest"
    assert [r.sequence for r in rows] == list(range(14))


def test_derived(events):
    pairs = {r.tool_use_id: r.result_event_id for r in pairing.tool_pairs(events).collect()}
    assert pairs == {"t0": "u3", "t1": "u5", "t2": "u8"}
    e = events.where("session_id = 's1'")
    got = episodes.episodes(e).collect()
    assert len(got) == 1
    x = got[0]
    assert (x.problem_event_id, x.fix_event_id, x.verification_event_id, x.status, x.fix_commit_hash) == ("u3", "a4", "u5", "resolved", "abc1234")
    assert x.problem_description.startswith("Ask: fix auth. Error: Traceback") and x.touched_files == ["/w/auth.py"] and x.tags == ["python"]
    assert sessions.outcomes(e).first().outcome == "fixed"
    roll = sessions.rollup(e.withColumn("ts", e.ts.cast("timestamp_ntz"))).first()
    assert (roll.tool_call_count, roll.file_edit_count, roll.model) == (3, 1, "m")


def test_replay_chain(spark):
    rows = [("s", 0, "e0", "write", None, "def f():\n  return 1\n"), ("s", 1, "e1", "edit", "f", "g"), ("s", 2, "e2", "edit", "1", "2"), ("s", 3, "e3", "edit", "  return 2", "  x = 3\n  return 2")]
    e = spark.createDataFrame([("p.py", "tool_call", *r) for r in rows], "file_path string, event_type string, session_id string, sequence long, event_id string, file_operation string, old_content string, new_content string")
    end = replay.file_states(e).first()
    assert end.edits_applied == 4 and "x = 3" in end.content and "return 2" in end.content
    targets = spark.createDataFrame([("s", "p.py", 2)], "session_id string, file_path string, until long")
    mid = replay.file_states(e, targets).first()
    assert mid.edits_applied == 3 and "x = 3" not in mid.content and "return 2" in mid.content


def walk_spec(rows):
    """A second, plainer reading of the episode rules."""
    out, i = [], 0
    while i < len(rows):
        if rows[i]["kind"] != "error":
            i += 1
            continue
        names = {f.split("/")[-1] for f in rows[i]["refs"]}
        touched, said, diag, fix, ver, j, stop = set(rows[i]["refs"]), [], None, None, None, i + 1, False
        while j < len(rows) and not stop:
            r = rows[j]
            if r["kind"] == "error" and j > i + 1 and (fix is None or (r["refs"] and not set(r["refs"]) & touched)):
                break
            if r["long_text"] and fix is None:
                said.append(r["low"])
            if r["kind"] == "thinking" and diag is None and (any(w in r["low"] for w in rows[i]["words"]) or any(n in r["low"] for n in names)):
                diag = j
            if r["kind"] == "edit":
                touched.add(r["file_path"])
                n = r["file_path"].split("/")[-1]
                if fix is None and (n in names or diag is not None or any(n in t or (len(n.split(".")[0]) >= 4 and n.split(".")[0] in t) for t in said)):
                    fix = j
            if r["kind"] == "clean" and fix is not None and not r["failed"]:
                ver, stop = j, True
            j += 1
        out.append((i, diag, fix, ver))
        i = max(j, i + 1)
    return out


def test_walk_against_spec():
    import random

    r = random.Random(7)
    for _ in range(300):
        rows = []
        for i in range(r.randrange(1, 25)):
            kind = r.choice(["error", "clean", "thinking", "said", "edit"])
            low = r.choice(["about alpha.py", "nothing", "the beta thing", "keyerror"])
            rows.append({"idx": i, "kind": kind, "refs": r.choice([[], ["/x/alpha.py"], ["/x/beta.py"]]), "words": ["keyerror"], "low": low, "long_text": kind in ("thinking", "said") and r.random() < 0.6, "failed": r.random() < 0.3, "file_path": r.choice(["/x/alpha.py", "/y/beta.py"])})
        assert [x[:4] for x in episodes.walk(rows)] == walk_spec(rows)
