"""Streams give what the batch gives."""

import pathlib
import tempfile

from pyspark.sql import functions as F

from tracelake.sources import tables
from tracelake.streaming import live


def lines(query, spark):
    query.processAllAvailable()
    return sorted((r.path[-1], r.raw) for r in spark.table("tailed").collect())


def test_tail(spark):
    d = pathlib.Path(tempfile.mkdtemp(prefix="spark-t-"))
    f = d / "a.jsonl"
    f.write_bytes(b"one\ntwo\npart")
    rows = live.tail(spark, str(d)).withColumn("path", F.lit("a"))
    q = rows.writeStream.format("memory").queryName("tailed").start()
    try:
        assert lines(q, spark) == [("a", "one"), ("a", "two")]
        with f.open("ab") as out:
            out.write(b"ial\n\nthree\n")
        assert lines(q, spark) == [("a", "one"), ("a", "partial"), ("a", "three"), ("a", "two")]
    finally:
        q.stop()


def test_reader_restarts_on_smaller_files():
    d = pathlib.Path(tempfile.mkdtemp(prefix="spark-t-"))
    (d / "a.jsonl").write_bytes(b"long line one\nlong line two\n")
    r = live.TailReader({"path": str(d), "batch": "4"})
    rows, off = r.read({})
    assert [x[2] for x in rows] == ["long line one"] and list(r.readBetweenOffsets({}, off))[0][2] == "long line one"
    rows, off = r.read(off)
    assert [x[2] for x in rows] == ["long line two"]
    (d / "a.jsonl").write_bytes(b"new\n")
    assert [x[2] for x in r.read(off)[0]] == ["new"]


def _events(spark, d, n, start=0):
    spark.createDataFrame([(f"e{i % n}", f"s{i % 3}", i) for i in range(start, start + n)], "event_id string, session_id string, i long").selectExpr("event_id", "session_id", "timestamp_seconds(1700000000 + i) as ts").write.mode("append").parquet(d)


def test_numbers_and_repeats(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = tempfile.mkdtemp(prefix="spark-t-")
    _events(spark, f"{d}/in", 9)
    stream = lambda: spark.readStream.schema("event_id string, session_id string, ts timestamp").parquet(f"{d}/in")
    q = live.unrepeated(stream()).writeStream.format("memory").queryName("unrepeated").start()
    try:
        q.processAllAvailable()
        _events(spark, f"{d}/in", 9)
        q.processAllAvailable()
        assert spark.table("unrepeated").count() == 9
    finally:
        q.stop()
    q = live.numbered(stream()).writeStream.format("memory").queryName("numbered").start()
    try:
        q.processAllAvailable()
        _events(spark, f"{d}/in", 6, 100)
        q.processAllAvailable()
        got = {}
        for r in spark.table("numbered").collect():
            got.setdefault(r.session_id, []).append(r.sequence)
        assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 24
    finally:
        q.stop()


def test_upserts(spark):
    d = tempfile.mkdtemp(prefix="spark-t-")
    _events(spark, f"{d}/in", 5)
    stream = spark.readStream.schema("event_id string, session_id string, ts timestamp").parquet(f"{d}/in")
    for _ in range(2):
        live.upsert_stream(stream, f"{d}/table", f"{d}/cp", ["event_id"]).awaitTermination()
        _events(spark, f"{d}/in", 7)
    assert tables.keyed_table(spark, f"{d}/table").count() == 7
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, tables.upserted(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size int")
    assert [r.path for r in tables.to_ingest(files, files.where("path = 'a'")).collect()] == ["b"]


def test_live_ingest_and_whole_pass(spark):
    import json

    from tracelake import parse

    d = pathlib.Path(tempfile.mkdtemp(prefix="spark-t-"))
    (d / "in").mkdir()
    f = d / "in" / "a.jsonl"
    entry = lambda i: json.dumps({"type": "user", "uuid": f"u{i}", "sessionId": "s", "timestamp": f"2024-01-01T00:00:0{i}Z", "message": {"role": "user", "content": f"text {i}"}}) + "\n"
    f.write_text(entry(0) + entry(1))
    q = live.live_ingest(live.tail(spark, str(d / "in")), str(d / "table"), str(d / "cp"))
    try:
        q.processAllAvailable()
        with f.open("a") as out:
            out.write(entry(2) + entry(3))
        q.processAllAvailable()
    finally:
        q.stop()
    got = lambda: sorted((r.event_id, r.sequence, r.content) for r in tables.keyed_table(spark, str(d / "table")).collect())
    assert got() == [(f"u{i}", i, f"text {i}") for i in range(4)]
    f.write_text(entry(1) + entry(4))
    lines = spark.createDataFrame([(str(f), i, x) for i, x in enumerate(f.read_text().splitlines())], "path string, line_no long, raw string")
    live.whole_pass(lines, str(d / "table"))
    assert got() == sorted((r.event_id, r.sequence, r.content) for r in parse.events(lines).collect()) and len(got()) == 2
    # a write that did not commit is not seen
    (d / "table" / "version=000000000099" / "key_bucket=1").mkdir(parents=True)
    assert len(got()) == 2


def test_numbers_go_on_from_a_table(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = tempfile.mkdtemp(prefix="spark-t-")
    _events(spark, f"{d}/in", 6)
    stored = spark.createDataFrame([("s1", 4), ("s1", 7), ("s2", 0)], "session_id string, sequence long")
    stream = spark.readStream.schema("event_id string, session_id string, ts timestamp").parquet(f"{d}/in")
    q = live.numbered(stream, stored).writeStream.format("memory").queryName("numbered_on").start()
    try:
        q.processAllAvailable()
        assert sorted((r.session_id, r.sequence) for r in spark.table("numbered_on").collect()) == [("s0", 0), ("s0", 1), ("s1", 8), ("s1", 9), ("s2", 1), ("s2", 2)]
    finally:
        q.stop()


def test_results_find_calls_of_earlier_batches(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = tempfile.mkdtemp(prefix="spark-t-")
    schema = "session_id string, event_id string, ts timestamp, event_type string, tool_use_id string, tool_name string"
    put = lambda rows: spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{d}/in")
    put([("s", "c1", "2024-01-01 00:00:00", "tool_call", "t1", "Bash"), ("s", "c2", "2024-01-01 00:00:01", "tool_call", "t2", "Read"), ("s", "r2", "2024-01-01 00:00:02", "tool_result", "t2", None)])
    q = live.linked(spark.readStream.schema(schema).parquet(f"{d}/in")).writeStream.format("memory").queryName("linked").start()
    try:
        q.processAllAvailable()
        put([("s", "r1", "2024-01-01 00:01:00", "tool_result", "t1", None), ("x", "r9", "2024-01-01 00:01:00", "tool_result", "t1", None)])
        q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("linked").where("call_event_id is not null").collect()) == [("s", "r1", "c1", "Bash"), ("s", "r2", "c2", "Read")]
        assert spark.table("linked").where("event_id = 'r9' and call_event_id is null").count() == 1
    finally:
        q.stop()


def _transcript(path, n, session="s"):
    """Entries of one file: texts, calls, results that fail, repeats of blank blocks and entries without ids."""
    import json

    out = []
    for i in range(n):
        base = {"uuid": f"{session}{i}", "sessionId": session, "timestamp": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "cwd": f"/srv/{i % 3}"}
        if i % 5 == 0:
            entry = base | {"type": "user", "message": {"role": "user", "content": f"text {i} é"}}
        elif i % 5 == 1:
            use = {"type": "tool_use", "id": f"t{i}", "name": "Bash", "input": {"command": "git commit -m x"}}
            entry = base | {"type": "assistant", "message": {"role": "assistant", "model": f"m{i % 2}", "content": [{"type": "text", "text": "do"}, use, {"type": "text", "text": " "}]}}
        elif i % 5 == 3:
            said = "[main 1234567] x" if i % 2 else "Traceback (most recent call last):\n  boom"
            entry = base | {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"t{i - 2}", "content": said}]}}
        else:
            entry = {k: v for k, v in base.items() if k != "uuid"} | {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": f"said {i}"}]}}
        out.append(json.dumps(entry, ensure_ascii=False) + "\n")
    path.write_text("".join(out))
    return path.read_bytes()


def test_live_tables_equal_one_pass_after_any_cut(spark):
    import random

    from tracelake import parse
    from tracelake.operators import pairing, sessions

    d = pathlib.Path(tempfile.mkdtemp(prefix="spark-t-"))
    (d / "in").mkdir()
    whole = {f"{x}.jsonl": _transcript(d / f"{x}.jsonl", n, x) for x, n in (("a", 23), ("b", 12))}
    rng = random.Random(3)
    cuts = {name: sorted(rng.randrange(len(data)) for _ in range(1)) + [len(data)] for name, data in whole.items()}
    at = dict.fromkeys(whole, 0)
    for step in range(2):
        for name, data in whole.items():
            with (d / "in" / name).open("ab") as out:
                out.write(data[at[name] : cuts[name][step]])
            at[name] = cuts[name][step]
        q = live.live_tables(live.tail(spark, str(d / "in"), batch=700), str(d / "t"), str(d / "cp"), availableNow=True)
        q.awaitTermination()
    lines = live.whole_lines(spark.createDataFrame([(str(d / "in" / n),) for n in whole], "path string"))
    e = parse.events(lines).persist()
    rows = lambda df, cols: sorted(str([r[c] for c in cols]) for r in df.collect())
    cols = ["event_id", "sequence", "session_id", "event_type", "content", "error_detected", "error_category", "git_operation", "git_commit_hash"]
    assert rows(tables.keyed_table(spark, str(d / "t" / "events")), cols) == rows(e, cols) and e.where("error_detected").count() and e.where("git_commit_hash is not null").count()
    want = pairing.tool_pairs(e)
    assert rows(live.stored_pairs(spark, str(d / "t")), want.columns) == rows(want, want.columns)
    want = sessions.live_rollup(e)
    assert rows(live.stored_sessions(spark, str(d / "t")), want.columns) == rows(want, want.columns)
    log = {r.transcript_path[-7:]: r.last_offset for r in tables.keyed_table(spark, str(d / "t" / "log")).collect()}
    assert log == {name: len(data) for name, data in whole.items()}
    # a batch that comes again, and a whole pass, change nothing
    before = rows(live.stored_sessions(spark, str(d / "t")), want.columns)
    live.whole_pass_tables(lines, str(d / "t"))
    assert rows(live.stored_sessions(spark, str(d / "t")), want.columns) == before
    assert rows(tables.keyed_table(spark, str(d / "t" / "events")), cols) == rows(e, cols)


def test_ranges_hold_each_line_once():
    d = pathlib.Path(tempfile.mkdtemp(prefix="spark-t-"))
    data = b"one\n\n" + b"x" * 300 + b"\ntwo\nlast"
    (d / "a.jsonl").write_bytes(data)
    for batch in (1, 2, 7, 1000):
        r = live.RangeReader({"path": str(d), "batch": str(batch)})
        parts = r.partitions({}, r.latestOffset())
        assert [(x[1], x[2]) for p in parts for x in r.read(p)] == [(0, "one"), (5, "x" * 300), (306, "two")]
    assert [x[2] for p in r.partitions({str(d / "a.jsonl"): 309}, {str(d / "a.jsonl"): 310}) for x in r.read(p)] == ["two"]
    assert r.partitions({str(d / "a.jsonl"): 500}, r.latestOffset())[0].low == 0  # the file became smaller


def test_still_files_are_told(spark):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = pathlib.Path(tempfile.mkdtemp(prefix="spark-t-"))
    (d / "in").mkdir()
    _transcript(d / "in" / "a.jsonl", 6)
    q = live.close_idle(live.tail(spark, str(d / "in")), str(d / "t"), str(d / "cp"), wait=1000)
    try:
        end = time.time() + 60
        while time.time() < end and not tables.manifest(spark, str(d / "t" / "log")):
            time.sleep(1)
        assert live.stored_sessions(spark, str(d / "t")).first().event_count == 7
    finally:
        q.stop()


def test_keyed_table_grows_by_parts(spark):
    """Small writes add small parts; merged parts, mixed keys, repeated marks and splits give what a dict gives."""
    import random

    d, rng, model = tempfile.mkdtemp(prefix="spark-t-") + "/t", random.Random(1), set()
    old, tables.BUCKET_BYTES = tables.BUCKET_BYTES, 600
    try:
        for step in range(7):
            rows = [(rng.choice([None, *range(60)]), rng.randrange(4), step * 100 + i) for i in range(300 if step == 0 else 9)]
            key = ["a"] if step == 3 else ["a", "b"]
            gone = {r[: len(key)] for r in rows}
            model = {r for r in model if r[: len(key)] not in gone} | set(rows)
            for again in (rows, [(1, 1, -1)]):
                tables.keyed_overwrite(spark, d, spark.createDataFrame(again, "a int, b int, c int"), key, ["a"], ("w", step))
            assert set(map(tuple, tables.keyed_table(spark, d).collect())) == model
            near = tables.keyed_table(spark, d, spark.createDataFrame([(3,)], "a int"))
            assert {tuple(r) for r in near.where("a = 3").collect()} == {r for r in model if r[0] == 3}
        parts = tables.manifest(spark, d)
        assert parts["buckets"] > tables.BUCKETS and len(parts["parts"]) <= 4
        tables.compact(spark, d, whole=True)
        assert set(map(tuple, tables.keyed_table(spark, d).collect())) == model and len(tables.manifest(spark, d)["parts"]) == 1
    finally:
        tables.BUCKET_BYTES = old


def test_old_calls_leave_the_state(spark):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    d = tempfile.mkdtemp(prefix="spark-t-")
    schema = "session_id string, event_id string, ts timestamp, event_type string, tool_use_id string, tool_name string"
    put = lambda *row: spark.createDataFrame([row], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{d}/in")
    put("s", "c1", "2024-01-01 00:00:00", "tool_call", "t1", "Bash")
    q = live.linked(spark.readStream.schema(schema).parquet(f"{d}/in"), keep=1).writeStream.format("memory").queryName("kept").start()
    try:
        time.sleep(8)
        put("s", "r1", "2024-01-01 00:00:01", "tool_result", "t1", None)
        end = time.time() + 40
        while time.time() < end and not spark.table("kept").count():
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("kept").collect()] == [("s", "r1", None, None)]
    finally:
        q.stop()
