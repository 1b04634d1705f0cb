"""Tailing growing transcripts and keeping sessions up to date as a stream."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import parse
from ..operators.sessions import live_rollup
from ..sources.tables import keyed_overwrite, keyed_table, manifest

LINES = "path string, line_no long, raw string, line_end long"
STEP = 1 << 16


def _transcripts(folder: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, "**", "*.jsonl"), recursive=True))


def _lines(path: str, low: int, high: int) -> Iterator[tuple[str, int, str, int]]:
    """Lines whose line feed lies in the bytes low to high; the first may begin before low."""
    with open(path, "rb") as f:
        at = low
        while at > 0:  # back to the line feed before low
            step = min(STEP, at)
            f.seek(at - step)
            place = f.read(step).rfind(b"\n")
            at = at - step + place + 1 if place >= 0 else at - step
            if place >= 0:
                break
        f.seek(at)
        while at < high:
            line = f.readline()
            end = at + len(line)
            if not line.endswith(b"\n") or end > high:
                return
            if line.strip():
                yield path, at, line[:-1].decode("utf-8", "replace"), end
            at = end


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class RangeReader(DataSourceStreamReader):
    """Lines that end with a line feed, read by the tasks: one input partition for each file and `batch` bytes.

    The offset is {path: size}.  A line belongs to the range that holds its line feed, so an unfinished last line comes with the batch that ends
    it, and the driver reads names and sizes alone.  A file that became smaller starts again; one that is gone is forgotten.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.batch = options["path"], int(options.get("batch", 8 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: os.path.getsize(p) for p in _transcripts(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, high in end.items():
            low = int(start.get(path, 0))
            low = 0 if high < low else low
            out += [Range(path, i, min(i + self.batch, high)) for i in range(low, high, self.batch)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        return _lines(part.path, part.low, part.high)


class TailReader(SimpleDataSourceStreamReader):
    """Lines that end with a line feed after each file's offset; an unfinished last line waits for its end.

    The offset is {path: bytes}; a file that became smaller starts again.  At most `batch` bytes a file and batch.  This
    reader runs on the driver, for a few small files whose batches must be bounded; RangeReader is for all else.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.batch = options["path"], int(options.get("batch", 8 << 20))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple:
        end, rows = dict(start), []
        for path in _transcripts(self.folder):
            at = int(start.get(path, 0))
            at = 0 if os.path.getsize(path) < at else at
            with open(path, "rb") as f:
                f.seek(at)
                data = f.read(self.batch)
                while data and b"\n" not in data and (more := f.read(self.batch)):
                    data += more
            whole = data[: data.rfind(b"\n") + 1]
            place = at
            for line in whole.split(b"\n")[:-1]:
                if line.strip():
                    rows.append((path, place, line.decode("utf-8", "replace"), place + len(line) + 1))
                place += len(line) + 1
            end[path] = at + len(whole)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        for path, stop in end.items():
            at = int(start.get(path, 0))
            at = 0 if stop < at else at
            with open(path, "rb") as f:
                f.seek(at)
                for line in f.read(stop - at).split(b"\n")[:-1]:
                    if line.strip():
                        yield (path, at, line.decode("utf-8", "replace"), at + len(line) + 1)
                    at += len(line) + 1


class TranscriptTail(DataSource):
    """Format "transcript_tail": (path, line_no, raw, line_end); line_no and line_end are the line's first byte and the one after its line feed."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> RangeReader:
        return RangeReader(self.options)


class SmallTail(DataSource):
    """Format "transcript_tail_small": the same rows, read on the driver."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail_small"

    def schema(self) -> str:
        return LINES

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, folder: str, batch: int = 8 << 20, small: bool = False) -> DataFrame:
    """New lines of the transcripts below a folder that driver and executors see under one path."""
    source = SmallTail if small else TranscriptTail
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("path", folder).option("batch", batch).load()


class Sequence(StatefulProcessor):
    """Numbers each session's events on from the last batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.next.update((int(initialState["next"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues):
        n = self.next.get()[0] if self.next.exists() else 0
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "event_id"])
            out = pd.DataFrame({"session_id": key[0], "event_id": pdf["event_id"], "sequence": range(n, n + len(pdf))})
            n += len(pdf)
            yield out
        self.next.update((n,))

    def close(self) -> None:
        pass


def numbered(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(session_id, event_id, sequence) of a stream with session_id, event_id and ts; needs the RocksDB state store.

    Sessions of stored (session_id, sequence) go on after their largest sequence.
    """
    first = None if stored is None else stored.groupBy("session_id").agg((F.max("sequence") + 1).alias("next")).groupBy("session_id")
    return events.select("session_id", "event_id", "ts").groupBy("session_id").transformWithStateInPandas(Sequence(), "session_id string, event_id string, sequence long", "Append", "None", initialState=first)


class Calls(StatefulProcessor):
    """Remembers a session's calls until their result comes (or, if given, `keep` milliseconds have passed), so results in later batches find theirs."""

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "tool_use_id string", "event_id string, tool_name string", self.keep)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            out = []
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                if r.tool_use_id is None:
                    continue
                if r.event_type == "tool_call":
                    self.calls.updateValue((r.tool_use_id,), (r.event_id, r.tool_name))
                elif r.event_type == "tool_result":
                    known = self.calls.containsKey((r.tool_use_id,))
                    out.append((key[0], r.event_id, *(self.calls.getValue((r.tool_use_id,)) if known else (None, None))))
                    if known:
                        self.calls.removeKey((r.tool_use_id,))
            yield pd.DataFrame(out, columns=["session_id", "event_id", "call_event_id", "call_tool"])

    def close(self) -> None:
        pass


def linked(events: DataFrame, keep: int | None = None) -> DataFrame:
    """(session_id, event_id, call_event_id, call_tool) of a stream's results; a call may come in an earlier batch.

    keep: milliseconds after which a call leaves the state.  The stream then runs by processing time: its batches go on without new rows.
    """
    cols = ["session_id", "event_id", "ts", "event_type", "tool_use_id", "tool_name"]
    return events.select(*cols).groupBy("session_id").transformWithStateInPandas(Calls(keep), "session_id string, event_id string, call_event_id string, call_tool string", "Append", "ProcessingTime" if keep else "None")


def live_ingest(lines: DataFrame, path: str, checkpoint: str):
    """A stream of new lines (path, line_no, raw) into the keyed table of events; starts and returns the query.

    A file's new events are numbered on from its largest stored sequence.  A repeated batch replaces its own events.  Links and
    ids that need earlier lines are best effort until `whole_pass` reads the closed file; `live_tables` has them at once.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        e = parse.events(batch)
        if manifest(spark, path):
            ids = e.select("transcript_path", "event_id").distinct()
            before = keyed_table(spark, path, ids).join(ids, ["transcript_path", "event_id"], "left_anti").groupBy("transcript_path").agg((F.max("sequence") + 1).alias("_next"))
            e = e.join(before, "transcript_path", "left").withColumn("sequence", F.col("sequence") + F.coalesce("_next", F.lit(0))).drop("_next")
        keyed_overwrite(spark, path, e, ["transcript_path", "event_id"], ["transcript_path"])

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def whole_pass(lines: DataFrame, path: str) -> None:
    """Parses the whole lines of closed files and replaces all that the table holds of these files."""
    keyed_overwrite(lines.sparkSession, path, parse.events(lines), ["transcript_path"], ["transcript_path"])


# ---------------------------------------------------------------- all tables of a live ingest

FILE = ["transcript_path"]
PAIR = ["transcript_path", "session_id", "tool_use_id"]
COUNTS = ["event_count", "user_message_count", "assistant_message_count", "tool_call_count"]


def _stored(spark: SparkSession, path: str, near: DataFrame, schema: str) -> DataFrame:
    """The rows of a table whose file is one of near (transcript_path); none where nothing was written yet."""
    if not manifest(spark, path):
        return spark.createDataFrame([], schema)
    return keyed_table(spark, path, near).join(near.select("transcript_path").distinct(), "transcript_path", "left_semi")


def _pairs(events: DataFrame) -> DataFrame:
    """One row a file, session and tool_use_id: its last call and its last result, as structs that begin with the sequence."""
    of = lambda kind, *c: F.max(F.when(F.col("event_type") == kind, F.struct("sequence", "event_id", *c)))
    return events.where("tool_use_id is not null and event_type in ('tool_call', 'tool_result')").groupBy(*PAIR).agg(of("tool_call", "tool_name", "command").alias("call"), of("tool_result", "error_detected").alias("result"))


def _rollups(events: DataFrame) -> DataFrame:
    """The live roll-up of each file and session."""
    both = F.struct("transcript_path", "session_id")
    return live_rollup(events.withColumn("session_id", both)).select("session_id.*", *COUNTS, "started_at", "ended_at", "cwd", "model")


def _added(rollups: DataFrame, key: list[str]) -> DataFrame:
    return rollups.groupBy(*key).agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("started_at").alias("started_at"), *[F.max(c).alias(c) for c in ("ended_at", "cwd", "model")])


def _logged(lines: DataFrame, events: DataFrame) -> DataFrame:
    """(transcript_path, last_offset, events) of the lines and what they gave."""
    n = events.groupBy("transcript_path").agg(F.count(F.lit(1)).alias("events"))
    return lines.groupBy(F.col("path").alias("transcript_path")).agg(F.max("line_end").alias("last_offset"), F.min("line_no").alias("first")).join(n, "transcript_path", "left").na.fill(0, ["events"])


def live_tables(lines: DataFrame, folder: str, checkpoint: str, **trigger):
    """A stream of new lines (path, line_no, raw, line_end) into the tables events, pairs, sessions and log below a folder; starts and returns the query.

    Each batch is merged into what the tables hold of its own files: events are numbered and named on from the file's
    logged count, results find the calls of earlier batches, pairs keep the last call and result, counts of sessions add up, and the log holds
    each file's last offset.  Whatever the cuts, the tables are those of one pass over the files, but for ids that repeat in later batches: the
    event is replaced, not suffixed, and counts once.  A batch that failed half-way is finished when it comes again, since each table remembers the last batch it took.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, (checkpoint, number)
        own = f"{checkpoint}#{number}"
        batch = batch.persist()
        files = batch.select(F.col("path").alias("transcript_path")).distinct().persist()
        log = _stored(spark, f"{folder}/log", files, "transcript_path string, last_offset long, events long")
        pairs = _stored(spark, f"{folder}/pairs", files, _pairs_schema())
        again = batch.where("line_no = 0").select(F.col("path").alias("transcript_path"))  # a file that starts again is numbered from 0
        before = log.join(again, "transcript_path", "left_anti").select(F.col("transcript_path").alias("path"), "events")
        calls = pairs.where("call is not null").groupBy(F.col("transcript_path").alias("path"), "tool_use_id").agg(F.max("call").alias("c")).select("path", "tool_use_id", "c.tool_name", "c.command")
        e = parse.events(batch, before, calls).persist()
        known = _stored(spark, f"{folder}/events", files, "transcript_path string, event_id string, first_batch string").select("transcript_path", "event_id", "first_batch")
        marked = e.join(known, ["transcript_path", "event_id"], "left").withColumn("first_batch", F.coalesce("first_batch", F.lit(own)))
        keyed_overwrite(spark, f"{folder}/events", marked, ["transcript_path", "event_id"], FILE, mark)
        keyed_overwrite(spark, f"{folder}/pairs", pairs.unionByName(_pairs(e)).groupBy(*PAIR).agg(F.max("call").alias("call"), F.max("result").alias("result")), PAIR, FILE, mark)
        fresh = _rollups(_stored(spark, f"{folder}/events", files, "first_batch string").where(F.col("first_batch") == own)) if manifest(spark, f"{folder}/events") else None
        if fresh is not None:
            old = keyed_table(spark, f"{folder}/sessions", files).join(files, "transcript_path", "left_semi") if manifest(spark, f"{folder}/sessions") else fresh.limit(0)
            keyed_overwrite(spark, f"{folder}/sessions", _added(old.unionByName(fresh), ["transcript_path", "session_id"]), ["transcript_path", "session_id"], FILE, mark)
        came = _logged(batch, e).join(log.select("transcript_path", F.col("events").alias("_e")), "transcript_path", "left")
        total = F.col("events") + F.when(F.col("first") > 0, F.coalesce("_e", F.lit(0))).otherwise(0)
        keyed_overwrite(spark, f"{folder}/log", came.select("transcript_path", "last_offset", total.alias("events")), FILE, FILE, mark)
        for df in (e, files, batch):
            df.unpersist()

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _pairs_schema() -> str:
    return "transcript_path string, session_id string, tool_use_id string, call struct<sequence: bigint, event_id: string, tool_name: string, command: string>, result struct<sequence: bigint, event_id: string, error_detected: boolean>"


def stored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of a live ingest, with the columns of pairing.tool_pairs."""
    p = keyed_table(spark, f"{folder}/pairs").groupBy("session_id", "tool_use_id").agg(F.max("call").alias("call"), F.max("result").alias("result")).where("call is not null")
    return p.select("session_id", "tool_use_id", F.col("call.event_id").alias("call_event_id"), "call.tool_name", F.col("result.event_id").alias("result_event_id"), "result.error_detected")


def stored_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions of a live ingest, with the columns of sessions.live_rollup."""
    return _added(keyed_table(spark, f"{folder}/sessions"), ["session_id"])


def whole_pass_tables(lines: DataFrame, folder: str) -> None:
    """Parses the whole lines (path, line_no, raw, line_end) of closed files and replaces all that the four tables hold of these files."""
    spark, lines = lines.sparkSession, lines.persist()
    e = parse.events(lines).persist()
    keyed_overwrite(spark, f"{folder}/events", e.withColumn("first_batch", F.lit("whole")), FILE, FILE)
    keyed_overwrite(spark, f"{folder}/pairs", _pairs(e), FILE, FILE)
    keyed_overwrite(spark, f"{folder}/sessions", _rollups(e), FILE, FILE)
    keyed_overwrite(spark, f"{folder}/log", _logged(lines, e).drop("first"), FILE, FILE)
    e.unpersist()
    lines.unpersist()


def whole_lines(files: DataFrame) -> DataFrame:
    """All finished lines of files (path), read in the tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                held = []
                for line in _lines(path, 0, os.path.getsize(path)):
                    held.append(line)
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=["path", "line_no", "raw", "line_end"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "line_no", "raw", "line_end"])

    return files.select("path").distinct().mapInPandas(read, LINES)


class Idle(StatefulProcessor):
    """Tells a file once no line has come for `wait` milliseconds; new lines start the wait again."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.due = handle, handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues):
        for _ in rows:
            pass
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.wait
        self.handle.registerTimer(at)
        self.due.update((at,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        yield pd.DataFrame({"path": [key[0]]})

    def close(self) -> None:
        pass


def idle_files(lines: DataFrame, wait: int) -> DataFrame:
    """(path) of a stream's files, each time one has been still for `wait` milliseconds; needs the RocksDB state store."""
    return lines.select("path", "line_no").groupBy("path").transformWithStateInPandas(Idle(wait), "path string", "Append", "ProcessingTime")


def close_idle(lines: DataFrame, folder: str, checkpoint: str, wait: int = 1_800_000):
    """Runs the whole pass of each file that has been still for `wait` milliseconds; starts and returns the query.  It writes the tables of live_tables, so
    only one of the two may run on a folder at a time."""

    def put(batch: DataFrame, _: int) -> None:
        files = batch.persist()
        if not files.isEmpty():
            whole_pass_tables(whole_lines(files), folder)
        files.unpersist()

    return idle_files(lines, wait).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def unrepeated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops events whose id came before, within and across batches."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def upsert_stream(events: DataFrame, path: str, checkpoint: str, key: list[str], by: str = "ts"):
    """Keeps a keyed table up to date; of a batch's rows with one key the last by `by` counts, and a repeated batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(by, F.xxhash64(*rest))).alias("_r")).select(*key, "_r.*")
        keyed_overwrite(batch.sparkSession, path, last, key)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running totals of each session and day, closed by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "session_id").agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("event_type") == "tool_call").alias("tool_call_count"))
