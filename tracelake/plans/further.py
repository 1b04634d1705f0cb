"""Registered queries of scoped searches, links to git, views, upkeep and the parse, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .. import parse, rules
from ..functions import extract as X
from ..operators import episodes as G, projects as P, scoped as C, segments as H, sessions as S, status as ST
from ..sources.store import stored
from ..testmap import session_events as ev
from .registry import DIST_SQL, EPISODE_SQL, GAP, OUTCOME_SQL, ROLL_SQL, SEGMENT_SQL, SPLIT_SQL, WITH, _prints, _roots, listed_sql, query, table

OPS_SQL = "ops as (select event_id, session_id, ts, case k % 3 when 0 then 'commit' when 1 then 'push' else 'status' end as operation, case when k % 2 = 0 then 'h' || k else '' end as commit_hash from ev where event_type = 'tool_result')"
OWNER_SQL = "owners as (select distinct session_id, case when user_id % 5 > 0 then 'p' || (user_id % 7) end as project_id from ev)"


def _ops(e):
    kind = F.when(F.col("k") % 3 == 0, "commit").when(F.col("k") % 3 == 1, "push").otherwise("status")
    return e.where("event_type = 'tool_result'").select("event_id", "session_id", "ts", kind.alias("operation"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("h"), "k")).otherwise("").alias("commit_hash"))


def _owners(e):
    return e.select("session_id", F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("p"), F.col("user_id") % 7)).alias("project_id")).distinct()


@query(f"""{WITH}, {OPS_SQL}, {OWNER_SQL}, r as (select project_id, event_id, row_number() over (partition by project_id order by ts desc, event_id) as rank from ops join owners using (session_id)
 where project_id is not null and (operation <> 'commit' or commit_hash <> '')) select project_id, event_id, cast(rank as int) as rank from r where rank <= 20""")
def d5_git_of_projects(s, sf):
    e = ev(s, sf)
    return C.git_of_projects(_ops(e), _owners(e)).select("project_id", "event_id", "rank")


@query(f"""{WITH}, {OPS_SQL}, fixes as (select 'h' || k as commit_hash, arg_min(event_id, (ts, event_id)) as linked_episode_id from ev where error_detected and k % 4 = 0 group by k) select event_id, linked_episode_id from ops left join fixes using (commit_hash)""")
def d6_linked_commits(s, sf):
    e = ev(s, sf)
    fixes = e.where("error_detected and k % 4 = 0").select(F.col("event_id").alias("episode_id"), F.col("ts").alias("ended_at"), F.concat(F.lit("h"), "k").alias("fix_commit_hash"))
    return C.linked_commits(_ops(e), fixes).select("event_id", "linked_episode_id")


MEMBER_SQL = """own as (select distinct session_id, user_id % 7 as i from ev), members as (select 'p' || i as project_id, session_id from own where i < 4
  union select distinct 'p' || i, e.session_id from (select distinct i from own where i >= 4) join ev e on starts_with(e.file_path, '/srv/p' || i || '/'))"""


def _members(e):
    i = F.col("user_id") % 7
    projects = e.select(F.concat(F.lit("p"), i).alias("project_id"), F.concat(F.lit("/srv/p"), i).alias("canonical_path")).distinct()
    return C.sessions_of_projects(projects, e.select("session_id", F.when(i < 4, F.concat(F.lit("p"), i)).alias("project_id")).distinct(), e)


@query(f"{WITH}, {MEMBER_SQL} select * from members")
def d10_sessions_of_projects(s, sf):
    return _members(ev(s, sf))


@query(f"""{WITH}, {MEMBER_SQL}, hits as (select event_id, session_id, case when k % 5 > 0 then 'p' || (k % 7) end as project_id from ev where error_detected)
 select event_id from hits where project_id is null or (project_id, session_id) in (select (project_id, session_id) from members)""")
def d9_hits_in_project(s, sf):
    e = ev(s, sf)
    hits = e.where("error_detected").select("event_id", "session_id", F.when(F.col("k") % 5 > 0, F.concat(F.lit("p"), F.col("k") % 7)).alias("project_id"))
    return C.in_project(hits, _members(e)).select("event_id")


# ---------------------------------------------------------------- searches over the given vectors

ROW_SQL = """v as (select vec_id, embedding, 'p' || label as project_id, 's' || label || '-' || (vec_id % 5) as session_id, timestamp '2024-01-01' + to_hours(cast(vec_id as int)) as at, case when vec_id % 3 > 0 then vec_id end as fix, 'item ' || vec_id || ' failed' as text,
  case when vec_id % 4 = 0 then 'resolved' else 'partial' end as status from embeddings),
 q as (select vec_id as query_id, embedding, case when vec_id % 40 = 0 then project_id end as project_id, case when vec_id % 60 = 0 then timestamp '2024-01-03' end as since, case when vec_id % 100 = 0 then timestamp '2024-01-15' end as until from v where vec_id % 20 = 0)"""
NEAR = DIST_SQL.replace("b.embedding", "q.embedding")
WHEN = "(q.since is null or a.at >= q.since) and (q.until is null or a.at <= q.until)"


def _vectors(s, sf):
    i = F.col("vec_id")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))
    cols = [F.concat(F.lit("p"), "label").alias("project_id"), F.concat(F.lit("s"), "label", F.lit("-"), i % 5).alias("session_id"), at.alias("at"), F.when(i % 3 > 0, i).alias("fix_event_id"), F.concat(F.lit("item "), i, F.lit(" failed")).alias("problem_description")]
    return table(s, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), *cols, F.when(i % 4 == 0, "resolved").otherwise("partial").alias("status"), F.lit("").alias("diagnosis_summary"), F.lit("").alias("fix_summary"))


def _questions(s, sf):
    i = F.col("vec_id")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return _vectors(s, sf).where("vec_id % 20 = 0").select(i.alias("query_id"), "vector", F.when(i % 40 == 0, F.col("project_id")).alias("project_id"), F.when(i % 60 == 0, day("2024-01-03")).alias("since"), F.when(i % 100 == 0, day("2024-01-15")).alias("until"))


def _nearest_sql(on: str, k: int, name: str, more: str = "") -> str:
    return f"with {ROW_SQL}, d as (select q.query_id, a.vec_id as id, {NEAR} as distance from v a join q on {on}), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, id as {name}, distance, cast(rank as int) as rank from r where rank <= {k}{more}"


@query(_nearest_sql(f"(q.project_id is null or q.project_id = a.project_id) and {WHEN}", 5, "session_id"))
def i3_search_sessions(s, sf):
    v = _vectors(s, sf).select(F.col("vec_id").alias("session_id"), "vector", "project_id", F.col("at").alias("started_at"))
    return C.search_sessions(v, _questions(s, sf), 5)


@query(_nearest_sql("q.project_id is null or q.project_id = a.project_id", 4, "project_id"))
def i4_search_projects(s, sf):
    v = _vectors(s, sf).select(F.col("vec_id").alias("project_id"), "vector", F.col("project_id").alias("category"))
    return C.search_projects(v, _questions(s, sf).withColumnRenamed("project_id", "category"), 4)


@query(_nearest_sql(f"a.fix is not null and (q.project_id is null or q.project_id = a.project_id) and {WHEN}", 5, "episode_id"))
def i6_search_episodes(s, sf):
    v = _vectors(s, sf).withColumnsRenamed({"vec_id": "episode_id", "at": "ended_at"})
    return C.search_episodes(v, _questions(s, sf), 5, has_fix=True)


@query(f"""with {ROW_SQL}, ok as (select q.query_id, a.vec_id as id, a.at, case when q.query_id % 60 > 0 then {NEAR} end as distance from v a join q on a.fix is not null and a.status = 'partial' and contains(a.text, 'item 1') and (q.project_id is null or q.project_id = a.project_id) and {WHEN}),
 r as (select *, row_number() over (partition by query_id order by distance, case when distance is null then "at" end desc, id) as rank from ok) select query_id, id as episode_id, distance, cast(rank as int) as rank from r where rank <= 4""")
def i9_find_episodes(s, sf):
    """Every third question has no vector and gets the newest episodes that pass its filters."""
    q = _questions(s, sf).withColumn("projects", F.when(F.col("project_id").isNotNull(), F.array("project_id")))
    q = q.withColumn("vector", F.when(F.col("query_id") % 60 > 0, F.col("vector")))
    return C.find_episodes(q, _vectors(s, sf).withColumnsRenamed({"vec_id": "episode_id", "at": "ended_at"}), 4, status="partial", keyword="Item 1")


@query(f"""with {ROW_SQL}, d as (select q.query_id, a.vec_id as id, a.text, {NEAR} as distance from v a join q on (q.project_id is null or q.project_id = a.project_id) and {WHEN}),
 r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, id as segment_id, text as topic, distance from r where rank <= 3""")
def i10_find_segments(s, sf):
    q = _questions(s, sf).withColumn("projects", F.when(F.col("project_id").isNotNull(), F.array("project_id")))
    v = _vectors(s, sf).withColumnsRenamed({"vec_id": "segment_id", "at": "started_at", "problem_description": "topic"})
    return C.find_segments(q, v, 3).select("query_id", "segment_id", "topic", "distance")


@query(f"""with {ROW_SQL}, top as (select query_id, 'p' || (query_id // 20 % 7) as p from q where query_id % 100 >= 60), d as (select q.query_id, a.vec_id as id, p, {NEAR} as distance from v a join q on true left join top using (query_id) where p is null or a.project_id = p),
 r as (select *, row_number() over (partition by query_id order by distance, id) as rank from d) select query_id, id as event_id, distance, p as scoped_to from r where rank <= 5""")
def i11_scoped_events(s, sf):
    """Questions whose best project scores 0.6 or more search in its sessions only."""
    v, q = _vectors(s, sf), _questions(s, sf).drop("project_id")
    best = q.select("query_id", F.concat(F.lit("p"), F.floor(F.col("query_id") / 20) % 7).alias("project_id"), (F.col("query_id") % 100 / 100).alias("score"))
    members = v.select("project_id", "session_id").distinct()
    return C.scoped_events(q, best, members, v.select(F.col("vec_id").alias("event_id"), "session_id", "vector"), 5, least=0.6).select("query_id", "event_id", "distance", "scoped_to")


@query(f"""with {ROW_SQL}, w as (select *, row_number() over (partition by session_id order by vec_id) - 1 as n from v), d as (select q.query_id, a.session_id, a.n, row_number() over (partition by q.query_id order by {NEAR}, a.vec_id) as rank from q join v o on o.vec_id = q.query_id join w a on a.session_id = o.session_id),
 h as (select * from d where rank <= 3) select h.query_id, e.session_id, cast(e.n as bigint) as sequence, e.vec_id as event_id, bool_or(e.n = h.n) as is_match from h join w e on e.session_id = h.session_id and abs(e.n - h.n) <= 2 group by all""")
def i12_search_in_context(s, sf):
    v = _vectors(s, sf)
    n = (F.row_number().over(W.partitionBy("session_id").orderBy("vec_id")) - 1).cast("long")
    events = v.select(F.col("vec_id").alias("event_id"), "session_id", n.alias("sequence"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "session_id", "vector")
    return C.search_in_context(asked, events, v.select(F.col("vec_id").alias("event_id"), "session_id", "vector"), 3, 2)


# ---------------------------------------------------------------- views and upkeep


@query(f"""{WITH}, {EPISODE_SQL}, edits as (select x.episode_id, f.sequence as until, f.old_content as old, f.new_content as new, e.sequence, e.old_content as o, e.new_content as n, f.file_path from eps x join ev f on f.event_id = x.fix_event_id join ev e on e.session_id = f.session_id and e.file_path = f.file_path and e.file_operation = 'edit' and e.sequence <= f.sequence),
 l as (select episode_id, file_path, old, new, list({{'o': o, 'n': n}} order by sequence) as l from edits group by all)
 select x.episode_id, file_path, old, new, list_reduce(l, lambda a, y: case when instr(a.t, y.o) > 0 then {{'t': substring(a.t, 1, instr(a.t, y.o) - 1) || y.n || substring(a.t, instr(a.t, y.o) + length(y.o))}} else a end, {{'t': l[1].o}}).t as file_state_after from eps x left join l using (episode_id)""")
def j8_artifacts(s, sf):
    e = ev(s, sf)
    return C.artifacts(G.episodes(e), e).select("episode_id", "file_path", "old", "new", "file_state_after")


@query(f"""{WITH}, {EPISODE_SQL}, best as (select *, row_number() over (partition by session_id order by ended_at desc, episode_id) as r from eps), c as (select *, 'why did the item fail, permission denied in ' || session_id as query from best where r = 1),
 s as (select *, round(len(list_filter(list_distinct(regexp_extract_all(query, '[a-z]{{4,}}')), lambda w: contains(lower(problem_description || ' ' || diagnosis_summary || ' ' || fix_summary), w))) + 2 * confidence, 6) as relevance from c)
 select session_id as query_id, relevance, 'Found in session ' || substring(session_id, 1, 8) || ' at ' || strftime(ended_at, '%Y-%m-%d %H:%M') || chr(10) || chr(10) || 'Problem:' || chr(10) || problem_description || case when fix_summary <> '' then chr(10) || chr(10) || 'Fix:' || chr(10) || fix_summary else '' end as block from s where relevance >= 2""")
def j13_context_blocks(s, sf):
    g = G.episodes(ev(s, sf)).withColumns({"query_id": F.col("session_id"), "rank": F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ended_at"), "episode_id"))})
    asked = ev(s, sf).select(F.col("session_id").alias("query_id"), F.concat(F.lit("why did the item fail, permission denied in "), "session_id").alias("query")).distinct()
    return C.context_blocks(g, asked, least=2.0)


@query(f"""{WITH}, {EPISODE_SQL}, r as (select *, row_number() over (partition by session_id order by sequence desc, event_id) as r from ev), l as (select session_id, string_agg(concat_ws(' ', event_type, tool_name, trim(content)), chr(10) order by sequence) as last_events from r where r <= 5 group by session_id),
 o as (select session_id, problem_description, row_number() over (partition by session_id order by ended_at desc, episode_id) as r from eps where status = 'unresolved'), u as (select session_id, string_agg(substring(problem_description, 1, 100), chr(10) order by r) as unresolved from o where r <= 3 group by session_id)
 select session_id, last_events, coalesce(unresolved, '') as unresolved from l left join u using (session_id)""")
def l10_to_continue(s, sf):
    e = ev(s, sf)
    return C.to_continue(e, G.episodes(e), n=5).select("session_id", F.array_join("last_events", "\n").alias("last_events"), F.array_join("unresolved", "\n").alias("unresolved"))


HIT_SQL = """a as (select o_custkey as query_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as rank from orders), b as (select o_custkey as query_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders),
 merged as (select query_id, id, min((l, rank)) as place from (select *, 0 as l from a where rank <= 3 union all select *, 1 from b where rank <= 4) group by query_id, id), m as (select query_id, id, row_number() over (partition by query_id order by place, id) as rank from merged)"""


@query(f"with {HIT_SQL} select query_id, id, cast(rank as int) as rank from m where rank <= 5")
def l13_merged_hits(s, sf):
    o = table(s, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice")
    top = lambda n, *by: o.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= n)
    return C.merged_hits(top(3, "o_totalprice", "id"), top(4, "id"), "id", 5)


@query(f"{WITH}, {OUTCOME_SQL} select session_id, outcome from outcome where session_id in (select session_id from ev where error_detected and k % 9 = 0)")
def l3_looked_up(s, sf):
    e = ev(s, sf)
    return C.looked_up(S.outcomes(e), e.where("error_detected and k % 9 = 0"), "session_id").select("session_id", "outcome")


@query(f"""{WITH}, {EPISODE_SQL}, w as (select *, list_sort(list_transform(list_filter(regexp_extract_all(lower(substring(problem_description, 1, 300)), '[a-z][a-z0-9]{{4,}}'), lambda x: not list_contains({listed_sql(rules.PATTERN_STOPWORDS)}, x)), lambda x, i: {{'n': -length(x), 'i': i, 'x': x}})) as l, coalesce(error_category, 'unknown') as tag from eps),
 g as (select *, coalesce(l[1].x, 'general') as word from w), n as (select tag, word, count(*) as n, arg_max(case when fix_summary <> '' then fix_summary end, case when fix_summary <> '' then (ended_at, episode_id) end) as fix from g group by all having count(*) >= 2)
 select tag, word, n, fix from n order by n desc, tag, word limit 50""")
def e6_patterns(s, sf):
    return S.patterns(G.episodes(ev(s, sf)), least=2, top=50).select("tag", "word", "n", "fix")


@query("""with f as (select distinct user_id from events), k as (select user_id, max(case when event_type = 'purchase' then 1 end) as p from events where event_type in ('purchase', 'error') and event_id % 3 = 0 group by user_id)
 select user_id as transcript_path, case when k.user_id is null then 'missing' when p is null then 'no_project' else 'complete' end as bucket from f left join k using (user_id)""")
def m7_classified_files(s, sf):
    e = table(s, sf, "events")
    known = e.where("event_type in ('purchase', 'error') and event_id % 3 = 0").select(F.col("user_id").alias("transcript_path"), F.when(F.col("event_type") == "purchase", F.lit("p")).alias("project_id"))
    return C.classified_files(e.select(F.col("user_id").alias("transcript_path")).distinct(), known)


@query("select conv_id, turn from conversations where conv_id not in (select conv_id from conversations where role = 'system')")
def m7_lines_to_reingest(s, sf):
    c = table(s, sf, "conversations").withColumn("path", F.col("conv_id"))
    known = c.where("role = 'system'").select(F.col("conv_id").alias("transcript_path"), F.lit("p").alias("project_id"))
    return C.to_reingest(c, c.select(F.col("conv_id").alias("transcript_path")).distinct(), known).select("conv_id", "turn")


@query("select conv_id, turn from conversations where trim(text) <> '' and turn % 2 = 1")
def g9_texts_without_vectors(s, sf):
    c = table(s, sf, "conversations").where(F.trim("text") != "").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return C.without_vectors(c, c.where("turn % 2 = 0"), "id").select("conv_id", "turn")


@query()
def f10_inferred_projects(s, sf):
    """Questions that name no indexed project are matched once more with the projects of files that are not indexed yet."""
    prints = _prints(s, sf)
    late = F.pmod(F.xxhash64("project_id"), F.lit(3)) == 0
    q = table(s, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("what broke in P"), F.col("o_orderkey") % 9, F.lit("?")).alias("query"), F.lit("2024-02-10").cast("timestamp").alias("now"))
    return P.matched_or_inferred(q, P.merged(prints.where(~late)), P.merged(prints.where(late)), 3)


# ---------------------------------------------------------------- the parse

ENTRY_SQL = """yields as (select *, case role when 'assistant' then 2 + case when trim(text) <> '' then 1 else 0 end else 1 end as n from conversations),
 based as (select *, coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as base from yields),
 parts as (select *, unnest(case role when 'assistant' then [0, 1, 2] else [0] end) as o from based)"""


@query(f"""with {ENTRY_SQL} select cast(conv_id as varchar) as session_id, 'u' || conv_id || '-' || turn || case when role = 'assistant' then ':' || o else '' end as event_id, cast(base + o as bigint) as sequence,
 case when role = 'user' then 'user_message' when role = 'system' then 'system' when o = 0 then 'assistant_thinking' when o = 1 then 'assistant_text' else 'tool_call' end as event_type,
 case when role = 'assistant' and o = 0 then 'about turn ' || turn when role = 'assistant' and o = 2 then 'Tool: Bash' || chr(10) || 'command: ls ' || turn else text end as content, case when role = 'assistant' and o = 2 then 'Bash' end as tool_name from parts where not (role = 'assistant' and o = 1 and trim(text) = '')""")
def b2_parsed_entries(s, sf):
    """Conversations as transcript lines, parsed into events."""
    return parse.events(_lines(s, sf)).select("session_id", "event_id", "sequence", "event_type", "content", "tool_name")


@query(f"with {ENTRY_SQL} select 'u' || conv_id || '-' || turn || ':2' as event_id, 't' || conv_id || '-' || turn as tool_use_id, 'ls ' || turn as command from parts where o = 2")
def b5_tool_calls(s, sf):
    return parse.events(_lines(s, sf)).where("event_type = 'tool_call'").select("event_id", "tool_use_id", "command")


def _lines(s, sf):
    c = table(s, sf, "conversations")
    cell = lambda **k: F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(n) for n, v in k.items()])
    name = F.concat_ws("-", "conv_id", "turn")
    head = {"uuid": F.concat(F.lit("u"), name), "sessionId": F.col("conv_id").cast("string"), "timestamp": F.lit("2024-01-01T00:00:00Z")}
    user = F.to_json(cell(type="user", **head, message=cell(role="user", content=F.col("text"))))
    system = F.to_json(cell(type="system", **head, content=F.col("text")))
    blocks = [cell(type="thinking", thinking=F.concat(F.lit("about turn "), "turn")), cell(type="text", text=F.col("text")), cell(type="tool_use", id=F.concat(F.lit("t"), name), name="Bash", input=cell(command=F.concat(F.lit("ls "), "turn")))]
    bot = F.concat(F.lit('{"type":"assistant","uuid":"u'), name, F.lit('","sessionId":"'), F.col("conv_id").cast("string"), F.lit('","timestamp":"2024-01-01T00:00:00Z","message":{"role":"assistant","content":['), F.concat_ws(",", *[F.to_json(b) for b in blocks]), F.lit("]}}"))
    return c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", user).when(F.col("role") == "system", system).otherwise(bot).alias("raw"))


# ---------------------------------------------------------------- rules over varied texts

TOOLS = ["Bash", "Read", "shell", "Edit", "BashOutput"]


@query(f"""{WITH} select event_id, (error_detected and {listed_sql(TOOLS)}[k % 5 + 1] in ({", ".join(f"'{t}'" for t in rules.COMMAND_TOOLS)})) or not tool_success as error_detected,
 case when error_detected and {listed_sql(TOOLS)}[k % 5 + 1] in ({", ".join(f"'{t}'" for t in rules.COMMAND_TOOLS)}) then ['bash', 'python', 'test', 'python', 'http', 'bash', 'bash', 'compile'][k % 8 + 1] end as error_category from ev where event_type = 'tool_result'""")
def c2_error_gate_by_tool(s, sf):
    """The rules run for results of tools that execute commands and for no others."""
    e = ev(s, sf).where("event_type = 'tool_result'")
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("k") % 5 + 1).cast("int"))
    g = X.gated_error(F.col("content"), tool, F.col("tool_success"))
    return e.select("event_id", g["error_detected"].alias("error_detected"), g["error_category"].alias("error_category"))


@query("select user_id, string_agg(distinct l, ' ' order by l) as languages from (select user_id, ['python', 'typescript', 'rust', 'css', 'go'][event_id % 5 + 1] as l from events where event_id % 6 < 5) group by user_id")
def f5_languages_of_files(s, sf):
    end = F.element_at(F.array(*map(F.lit, ("pyi", "TSX", "rs", "scss", "go"))), (F.col("event_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/srv/f"), "event_id", F.lit("."), F.when(F.col("event_id") % 6 < 5, end).otherwise("zzz"))
    g = table(s, sf, "events").groupBy("user_id").agg(F.collect_set(path).alias("p")).withColumn("languages", F.array_join(P.languages(F.col("p")), " "))
    return g.where("languages <> ''").select("user_id", "languages")


@query("select user_id, string_agg(distinct e, ' ' order by e) as extensions from (select user_id, ['py', 'tsx', 'md', 'c'][event_id % 4 + 1] as e from events) group by user_id")
def c17_extensions_of_files(s, sf):
    end = F.element_at(F.array(*map(F.lit, ("py", "TSX", "md", "c"))), (F.col("event_id") % 4 + 1).cast("int"))
    g = table(s, sf, "events").groupBy("user_id").agg(F.collect_set(F.concat(F.lit("a.b/f"), "event_id", F.lit("."), end)).alias("p"))
    return g.select("user_id", F.array_join(X.extensions(F.col("p")), " ").alias("extensions"))


@query(f"""{WITH}, {OUTCOME_SQL}, {ROLL_SQL}, {EPISODE_SQL}, {SPLIT_SQL}, {SEGMENT_SQL}, {OPS_SQL}, own as (select session_id, substring(cwd, 6) as name, started_at from sess),
 rs as (select own.*, o.outcome, row_number() over (partition by name order by started_at desc, session_id) as r from own left join outcome o using (session_id)),
 ss as (select name, string_agg(session_id || ' ' || outcome, '; ' order by r) filter (where r <= 5) as sessions, max(outcome) filter (where r = 1) as last_outcome from rs group by name),
 re as (select name, e.episode_id, e.status, 'h' || p.k as hash, row_number() over (partition by name order by e.ended_at desc, e.episode_id) as r from eps e join own using (session_id) join ev p on p.event_id = e.problem_event_id),
 ten as (select * from re where r <= 10), ue as (select name, episode_id, row_number() over (partition by name order by r) as u from ten where status <> 'resolved'),
 es as (select name, string_agg(episode_id, ' ' order by r) filter (where r <= 5) as recent from ten group by name), us as (select name, string_agg(episode_id, ' ' order by u) filter (where u <= 5) as unresolved from ue group by name),
 lk as (select name, hash, arg_max(episode_id, r) as linked from ten group by all),
 ro as (select own.name, o.*, ev.k, row_number() over (partition by own.name order by o.ts desc, o.event_id) as r from ops o join own using (session_id) join ev using (event_id) where o.operation <> 'commit' or o.commit_hash <> ''),
 cs as (select ro.name, string_agg(event_id || ':' || coalesce(linked, ''), ' ' order by r) as commits, max('b' || k % 3) filter (where r = 1) as branch from ro left join lk on lk.name = ro.name and lk.hash = ro.commit_hash where r <= 20 group by ro.name),
 rg as (select name, segment_type || ' ' || topic as t, row_number() over (partition by name order by s.ended_at desc, segment_id) as r from segs s join own using (session_id)), gs as (select name, string_agg(t, '; ' order by r) as segments from rg where r <= 5 group by name)
 select ss.name as display_name, branch, last_outcome, commits, sessions, coalesce(recent, '') as recent, coalesce(unresolved, '') as unresolved, coalesce(segments, '') as segments from ss left join es using (name) left join us using (name) left join cs using (name) left join gs using (name)""")
def j10_project_status(s, sf):
    """Every project's status; an episode's commit stands for its problem's number, as the given events hold no commits."""
    e = stored(ev(s, sf), "events")
    roots = stored(_roots(e).select("session_id", P.project_id(F.col("project_path")).alias("project_id")), "roots")
    of = lambda df: df.join(roots, "session_id")
    eps = stored(G.episodes(e), "episodes").drop("fix_commit_hash").join(e.select(F.col("event_id").alias("problem_event_id"), F.concat(F.lit("h"), "k").alias("fix_commit_hash")), "problem_event_id")
    ops = _ops(e).join(e.select("event_id", F.concat(F.lit("b"), F.col("k") % 3).alias("branch"), F.col("content").alias("message")), "event_id")
    none = e.limit(0).select(F.lit("").alias("project_id"), F.lit(0).alias("stale_files"))
    got = ST.project_status(P.merged(_prints(s, sf, e)), of(S.rollup(e)), S.outcomes(e), of(eps), of(H.segments(e, gap=GAP)), ops, none, F.lit("2024-02-10").cast("timestamp"))
    text = lambda name, one, sep: F.coalesce(F.array_join(F.transform(name, one), sep), F.lit("")).alias(name)
    return got.select(
        "display_name", "branch", "last_outcome", text("commits", lambda x: F.concat(x["event_id"], F.lit(":"), F.coalesce(x["linked_episode_id"], F.lit(""))), " "),
        text("sessions", lambda x: F.concat(x["session_id"], F.lit(" "), x["outcome"]), "; "), text("recent", lambda x: x["episode_id"], " "), text("unresolved", lambda x: x["episode_id"], " "), text("segments", lambda x: F.concat(x["segment_type"], F.lit(" "), x["topic"]), "; "),
    )
