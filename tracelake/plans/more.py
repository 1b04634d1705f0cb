"""Further registered queries: single rules, steps of recall, and streams run to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import extract as X
from ..operators import episodes as G, projects as P, query as L, reanalyse as R, recall as J, replay as K, scoped as C, search as I, segments as H, sessions as S
from ..sources import store
from ..sources.tables import keyed_table
from ..streaming import live
from ..testmap import session_events as ev
from .registry import EPISODE_SQL, GAP, OUTCOME_SQL, ROLL_SQL, SEGMENT_SQL, SPLIT_SQL, WITH, _prints, _roots, query, table

PLAIN_STATE_SQL = """l as (select session_id, file_path, list({'id': event_id, 'o': old_content, 'n': new_content} order by sequence) as e from ev where file_operation = 'edit' group by all),
 plain as (select session_id, file_path, list_reduce(e, lambda a, x: case when instr(a.t, x.o) > 0 then {'t': substring(a.t, 1, instr(a.t, x.o) - 1) || x.n || substring(a.t, instr(a.t, x.o) + length(x.o))} else a end, {'t': e[1].o}).t as content, e[-1].id as last_event_id from l)"""
HASH = "substring(md5(cast(o_orderkey as varchar)), 1, 8)"


def _key():
    return F.col("o_orderkey").cast("string")


def _hash():
    return F.substring(F.md5(_key().cast("binary")), 1, 8)


@query(f"{WITH} select event_id, event_type = 'tool_result' and not tool_success as error_detected, cast(null as varchar) as error_category from ev where event_type = 'tool_result'")
def c2_error_gate(s, sf):
    """Results of reads and edits: the rules don't run, only the success flag counts."""
    e = ev(s, sf).where("event_type = 'tool_result'")
    g = X.gated_error(F.col("content"), F.lit("Read"), F.col("tool_success"))
    return e.select("event_id", g["error_detected"].alias("error_detected"), g["error_category"].alias("error_category"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'commit' when 1 then 'push' when 2 then 'log' end as sub from orders")
def c3_git_command(s, sf):
    m = F.col("o_orderkey") % 4
    command = F.when(m == 0, "cd x && git commit -m y").when(m == 1, "sudo GIT Push").when(m == 2, "make; git log").otherwise("digit me")
    return table(s, sf, "orders").select("o_orderkey", X.git_command(command).alias("sub"))


@query(f"select o_orderkey, 'host:a/b' as remote, {HASH} as commit_hash, 'main' as branch from orders")
def c5_git_push(s, sf):
    g = X.git_signal(F.lit("git push"), F.concat(F.lit("To host:a/b\n   1234567.."), _hash(), F.lit("  dev -> main")))
    return table(s, sf, "orders").select("o_orderkey", *[g[c].alias(c) for c in ("remote", "commit_hash", "branch")])


@query("select o_orderkey, 'b' || o_orderkey as branch, o_orderkey % 5 <> 0 as success from orders")
def c7_git_merge(s, sf):
    g = X.git_signal(F.concat(F.lit("git merge b"), _key()), F.when(F.col("o_orderkey") % 5 == 0, "CONFLICT (content): x").otherwise("done"))
    return table(s, sf, "orders").select("o_orderkey", g["branch"].alias("branch"), g["success"].alias("success"))


@query("select o_orderkey, 'dev' as branch, nullif(cast(o_orderkey % 6 as int), 0) as files_changed from orders")
def c8_git_status(s, sf):
    g = X.git_signal(F.lit("git status"), F.concat(F.lit("On branch dev\n"), F.repeat(F.lit("  modified:  a.py\n"), (F.col("o_orderkey") % 6).cast("int"))))
    return table(s, sf, "orders").select("o_orderkey", g["branch"].alias("branch"), g["files_changed"].alias("files_changed"))


@query(f"select o_orderkey, {HASH} as commit_hash, (o_orderkey % 3 + 1) || ' commits shown' as message from orders")
def c9_git_log(s, sf):
    g = X.git_signal(F.lit("git log --oneline"), F.repeat(F.concat(_hash(), F.lit(" text\n")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return table(s, sf, "orders").select("o_orderkey", g["commit_hash"].alias("commit_hash"), g["message"].alias("message"))


@query("select o_orderkey, 'origin' as remote, cast(o_orderkey % 9 + 1 as int) as files_changed from orders")
def c10_git_pull(s, sf):
    g = X.git_signal(F.lit("git pull"), F.concat(F.lit("From origin\n "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" files changed")))
    return table(s, sf, "orders").select("o_orderkey", g["remote"].alias("remote"), g["files_changed"].alias("files_changed"))


@query(f"{WITH} select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]{{4,}}'))), ' ') as words from ev")
def c19_error_keywords(s, sf):
    return ev(s, sf).select("event_id", F.array_join(F.array_sort(X.error_keywords(F.col("content"))), " ").alias("words"))


@query("select c_custkey, array_to_string(list_sort(['my shop ' || c_nationkey, 'my-shop_' || c_nationkey, 'shop', 'the crm', 'crm']), ',') as names from customer where c_nationkey < 100")
def f3_aliases(s, sf):
    a = P.aliases(F.concat(F.lit("/srv/my-shop_"), "c_nationkey"), F.lit("crm"))
    return table(s, sf, "customer").where("c_nationkey < 100").select("c_custkey", F.array_join(F.array_sort(a), ",").alias("names"))


@query(f"{WITH} select session_id, 'python' as languages from ev where file_path is not null group by session_id")
def f5_languages(s, sf):
    g = ev(s, sf).where("file_path is not null").groupBy("session_id").agg(F.collect_set("file_path").alias("p"))
    return g.select("session_id", F.array_join(P.languages(F.col("p")), " ").alias("languages"))


@query()
def f12_project_texts(s, sf):
    p = P.merged(_prints(s, sf))
    return p.select("project_id", F.concat_ws(" | ", "display_name", "category", F.array_join(F.slice("aliases", 1, 10), ", "), F.array_join(F.slice("keywords", 1, 20), ", "), F.array_join("languages", ", ")).alias("text"))


@query(f"{WITH}, g as (select event_id, epoch(ts) - lag(epoch(ts)) over (partition by session_id order by sequence) as wait from ev) select event_id, coalesce(wait > {GAP}, false) as gap from g")
def h3_time_gaps(s, sf):
    from ..operators.pairing import in_order

    at = F.col("ts").cast("timestamp").cast("double")
    return ev(s, sf).select("event_id", F.coalesce(at - F.lag(at).over(in_order()) > GAP, F.lit(False)).alias("gap"))


@query(f"{WITH}, {SPLIT_SQL}, {SEGMENT_SQL} select segment_type, count(*) as n from segs group by segment_type")
def h6_segment_types(s, sf):
    return H.segments(ev(s, sf), gap=GAP).groupBy("segment_type").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, case when instr(p_name, 'a') > 0 then substring(p_name, 1, instr(p_name, 'a') - 1) || '<x>' || substring(p_name, instr(p_name, 'a') + 1) else p_name end as one, replace(p_name, 'e', 'EE') as every from part")
def k1_apply_edit(s, sf):
    edit = lambda old, new, all_: K.apply_edit(F.col("p_name"), F.lit(old), F.lit(new), F.lit(all_))
    return table(s, sf, "part").select("p_partkey", edit("a", "<x>", False).alias("one"), edit("e", "EE", True).alias("every"))


@query("select p_partkey, replace(replace(p_name, 'a', 'b'), 'b', 'c') as done from part")
def k2_apply_edits(s, sf):
    e = lambda o, n: F.struct(F.lit(o).alias("old_string"), F.lit(n).alias("new_string"), F.lit(True).alias("replace_all"))
    return table(s, sf, "part").select("p_partkey", K.apply_edits(F.col("p_name"), F.array(e("a", "b"), e("b", "c"))).alias("done"))


CAND = "select o_custkey as query_id, o_orderkey as episode_id, o_orderkey % 3 = 0 as in_project, o_orderkey % 5 <> 0 as has_fix, cast(o_orderkey % 100 as double) / 50 as distance, o_orderdate as ended_at from orders"


def _candidates(s, sf):
    k = F.col("o_orderkey")
    return table(s, sf, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("episode_id"), (k % 3 == 0).alias("in_project"), (k % 5 != 0).alias("has_fix"), ((k % 100).cast("double") / 50).alias("distance"), F.col("o_orderdate").alias("ended_at"))


@query(f"""with c as ({CAND}), l as (select *, case when in_project and has_fix then 0 when has_fix then 1 else 2 end as level from c), m as (select *, min(level) over (partition by query_id) as step from l),
 r as (select *, row_number() over (partition by query_id order by distance, episode_id) as r from m where level = step or step = 2) select query_id, episode_id, step from r where r <= 4""")
def j3_relaxed_steps(s, sf):
    return J.relaxed(_candidates(s, sf), 4).select("query_id", "episode_id", "step")


@query(f"""with c as ({CAND}), s as (select *, round(greatest(0.0, (1 - distance) * 20) + 10 * (case when episode_id % 2 = 0 then 1 else 0 end) + 0.5 + 0.5 * greatest(0.0, 1 - greatest(1.0, floor((epoch(timestamp '2024-02-10') - epoch(ended_at)) / 86400)) / 365), 6)::double as score from c),
 r as (select *, row_number() over (partition by query_id order by score desc, episode_id) as rank from s) select query_id, episode_id, score, cast(rank as int) as rank from r where rank <= 3""")
def j4_ranked(s, sf):
    c = _candidates(s, sf).withColumns({"problem_description": F.when(F.col("episode_id") % 2 == 0, "a Crash here").otherwise("calm"), "diagnosis_summary": F.lit(None).cast("string"), "fix_summary": F.lit(""), "confidence": F.lit(0.5)})
    q = table(s, sf, "orders").select(F.col("o_custkey").alias("query_id")).distinct().select("query_id", F.lit("2024-02-10").cast("timestamp").alias("now"), F.array(F.lit("crash")).alias("words"))
    return J.ranked(c, q, 3).select("query_id", "episode_id", "score", "rank")


@query(f"with c as ({CAND}), r as (select *, row_number() over (partition by query_id order by distance, episode_id) as rank from c) select query_id, distance < 0.5 as passed from r where rank = 1")
def j5_quality_gate(s, sf):
    from pyspark.sql import Window as W

    c = _candidates(s, sf).withColumns({"rank": F.row_number().over(W.partitionBy("query_id").orderBy("distance", "episode_id")), "score": F.lit(0.0)})
    return J.gated(c, nearest=0.5)


@query(f"{WITH}, h as (select session_id, event_id, content, k % 20 as query_id, cast((sequence * 7 + k) % 100 as double) / 50 as distance from ev where event_type = 'user_message'), a as (select *, row_number() over (partition by query_id, session_id order by distance, event_id) as r from h), b as (select *, row_number() over (partition by query_id order by distance, event_id) as rank from a where r = 1) select query_id, session_id, event_id, cast(rank as int) as rank from b where rank <= 3")
def j6_best_per_session(s, sf):
    h = ev(s, sf).where("event_type = 'user_message'").select("session_id", "event_id", "content", (F.col("k") % 20).alias("query_id"), (((F.col("sequence") * 7 + F.col("k")) % 100).cast("double") / 50).alias("distance"))
    return J.best_per_session(h).select("query_id", "session_id", "event_id", "rank")


@query(f"{WITH} select session_id as path, string_agg(distinct cwd, ' ' order by cwd) as cwds from ev group by session_id")
def j12_cwd_sets(s, sf):
    return ev(s, sf).groupBy(F.col("session_id").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("cwd")), " ").alias("cwds"))


@query()
def i1_embedded_texts(s, sf):
    docs = table(s, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return I.embedder(docs, size=64)(docs).select("id", F.size("vector").alias("size"))


FOUR_SQL = ", ".join(f"{r}.{c} as {r}_{c}" for r in ("problem", "diagnosis", "fix", "verification") for c in ("event_type", "tool_name", "ts", "content"))
FOUR_JOIN = " ".join(f"left join ev {r} on {r}.event_id = e.{r}_event_id" for r in ("problem", "diagnosis", "fix", "verification"))


@query(f"{WITH}, {EPISODE_SQL} select e.episode_id, {FOUR_SQL} from eps e {FOUR_JOIN}")
def d15_events_of_episodes(s, sf):
    e = ev(s, sf)
    return C.episode_events(G.episodes(e), e)


@query(f"{WITH}, {EPISODE_SQL}, {PLAIN_STATE_SQL} select e.session_id, e.fix_event_id, e.episode_id, e.problem_event_id, t.file_path, t.content, {FOUR_SQL} from eps e {FOUR_JOIN} left join plain t on t.session_id = e.session_id and t.last_event_id = e.fix_event_id")
def l12_episode_detail(s, sf):
    """Each episode with its four events and the file as its fix left it."""
    e = ev(s, sf)
    g = G.episodes(e)
    states = K.file_states(e).select("session_id", "file_path", "content", F.col("last_event_id").alias("fix_event_id"))
    return g.select("episode_id", "session_id", "problem_event_id", "fix_event_id").join(states, ["session_id", "fix_event_id"], "left").join(C.episode_events(g, e), "episode_id")


@query(f"""{WITH}, {OUTCOME_SQL}, {EPISODE_SQL}, {SPLIT_SQL}, {SEGMENT_SQL}, c as (select (select count(*) from ev) as events, (select count(distinct session_id) from ev) as sessions, (select count(*) from ev where event_type = 'tool_call') as tool_calls,
 (select count(*) from ev where event_type = 'assistant_thinking') as thinking_blocks, (select count(*) from ev where file_operation = 'edit') as file_edits, (select count(*) from ev where error_detected) as errors,
 (select count(*) from outcome) as outcomes, (select count(*) from outcome where outcome = 'fixed') as fixed_sessions, (select count(*) from outcome where outcome = 'stuck') as stuck_sessions,
 (select count(*) from eps) as episodes, (select count(*) from eps where status = 'resolved') as resolved_episodes, (select count(*) from segs) as segments, (select count(distinct cwd) from ev) as projects)
 unpivot c on columns(*) into name name value value""")
def e5_statistics(s, sf):
    """Counts of events, outcomes, episodes, segments and projects; the given events hold no git operations."""
    e = ev(s, sf)
    return S.statistics(e, S.outcomes(e), G.episodes(e), H.segments(e, gap=GAP), P.merged(_prints(s, sf)))


@query(f"""{WITH}, {OUTCOME_SQL}, {ROLL_SQL}, {EPISODE_SQL}, msg as (select *, row_number() over (partition by session_id order by sequence) as r from ev where event_type = 'user_message'),
 first as (select session_id, arg_min(content, r) as first_message from msg where r <= 3 and content not like '<%' group by session_id), n as (select session_id, count(*) as episodes, count(*) filter (where status = 'resolved') as resolved from eps group by session_id)
 select s.session_id, s.started_at, o.outcome, f.first_message, substring(s.cwd, 6) as project, coalesce(n.episodes, 0) as episodes, cast(coalesce(n.resolved, 0) as bigint) as resolved
 from sess s left join outcome o using (session_id) left join first f using (session_id) left join n using (session_id) where s.started_at >= timestamp '2024-01-15'""")
def e7_recap(s, sf):
    """Recent sessions with project, outcome, first message and their episodes."""
    e = ev(s, sf)
    roots = _roots(e).select("session_id", P.project_id(F.col("project_path")).alias("project_id"))
    return S.recap(S.rollup(e).join(roots, "session_id", "left"), S.outcomes(e), e, F.lit("2024-01-15").cast("timestamp_ntz"), P.merged(_prints(s, sf)), G.episodes(e))


@query(f"{WITH}, {OUTCOME_SQL}, {EPISODE_SQL}, n as (select session_id, count(*) as episodes from eps group by session_id) select session_id, outcome, coalesce(episodes, 0) as episodes from outcome left join n using (session_id)")
def n2_reanalysed(s, sf):
    """Derived tables as of the middle of the month, brought up to date for the sessions that changed since: sessions by outcome and their number of episodes."""
    e, folder = ev(s, sf), _folder(s)
    derived = {"outcomes": S.outcomes, "episodes": G.episodes}
    R.reanalysed(e.where("ts < timestamp_ntz '2024-01-15'"), folder, derived)
    R.reanalysed(e, folder, derived)
    n = R.analysed(s, folder, "episodes").groupBy("session_id").agg(F.count(F.lit(1)).alias("episodes"))
    return R.analysed(s, folder, "outcomes").select("session_id", "outcome").join(n, "session_id", "left").na.fill(0)


# the number in a stored table's name stands for its derivation: raise it when that changes
_bases: dict[str, str] = {}


def _base(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _bases.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-streams-", dir="/tmp")
        _bases[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def _folder(spark) -> str:
    return f"{_base(spark)}/stream-{uuid.uuid4().hex}"


def _sessions(s, sf):
    """Sessions with their outcome, newest first on disk."""
    make = lambda: S.rollup(ev(s, sf)).join(S.outcomes(ev(s, sf)), "session_id", "left").withColumn("age", -F.unix_micros(F.col("started_at").cast("timestamp")))
    return store.kept(s, _base(s), "sessions-1", [f"{sf}/events.parquet"], make, ["age", "session_id"])


def _outcomes(s, sf):
    return store.kept(s, _base(s), "outcomes-1", [f"{sf}/events.parquet"], lambda: S.outcomes(ev(s, sf)), ["session_id"])


def _events(s, sf):
    return store.kept(s, _base(s), "events-1", [f"{sf}/events.parquet"], lambda: ev(s, sf), ["session_id", "sequence", "event_id"])


@query(f"{WITH} select 'events' as name, count(*) as n from ev union all select 'sessions', count(distinct session_id) from ev union all select 'outcomes', count(distinct session_id) from ev")
def l0_stored_tables(s, sf):
    """Derives and stores the sorted tables that the look-ups read, where they are not stored yet, and counts them."""
    of = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return of("events", _events(s, sf)).unionByName(of("sessions", _sessions(s, sf))).unionByName(of("outcomes", _outcomes(s, sf)))


@query(f"{WITH}, {OUTCOME_SQL}, {ROLL_SQL} select s.session_id, s.started_at, o.outcome from sess s join outcome o using (session_id) where o.outcome = 'fixed' order by s.started_at desc, s.session_id limit 50")
def l1_fixed_sessions(s, sf):
    got = _sessions(s, sf)
    return L.list_sessions(got.where("outcome = 'fixed'")).select("session_id", "started_at", "outcome")


@query(f"{WITH}, {OUTCOME_SQL}, {ROLL_SQL} select e.event_id, o.outcome, o.confidence from ev e join outcome o using (session_id) where e.error_detected")
def l3_point_lookups(s, sf):
    return _events(s, sf).where("error_detected").select("event_id", "session_id").join(_outcomes(s, sf), "session_id").select("event_id", "outcome", "confidence")


@query(f"{WITH} select event_id, session_id, sequence, content from ev where session_id in ('3-1', '17-4', '40-0', '100-2')")
def l3_session_events(s, sf):
    """The events of four sessions, from the row groups that hold them."""
    return store.point(_events(s, sf), "session_id", ["3-1", "17-4", "40-0", "100-2"]).select("event_id", "session_id", "sequence", "content")


@query(f"{WITH} select event_id, sequence from ev where sequence between 2 and 5")
def l4_sequence_range(s, sf):
    return L.sequence_range(_events(s, sf), 2, 5).select("event_id", "sequence")


def _streamed(s, sf):
    raw = s.readStream.schema(table(s, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern, so that a single file will do
    return raw.select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("view", "click"), "tool_call").otherwise("other").alias("event_type"))


@query("select cast(date_trunc('day', ts) as timestamp) as day, cast(user_id as varchar) as session_id, count(*) as event_count, count(*) filter (where event_type in ('view', 'click')) as tool_call_count from events group by all")
def m1_live_totals(s, sf):
    """A stream over the events, run until it has read them all."""
    out = _folder(s)
    put = lambda df, _: df.write.mode("overwrite").parquet(f"{out}/table")
    live.session_totals(_streamed(s, sf)).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{out}/table").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "session_id", "event_count", "tool_call_count")


@query("select cast(event_id as varchar) as event_id, cast(user_id as varchar) as session_id from events")
def m8_live_upserts(s, sf):
    """A keyed table kept by a stream."""
    out = _folder(s)
    live.upsert_stream(_streamed(s, sf), f"{out}/table", f"{out}/checkpoint", ["event_id"]).awaitTermination()
    return keyed_table(s, f"{out}/table").select("event_id", "session_id")
