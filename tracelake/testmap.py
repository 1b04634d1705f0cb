"""A session-shaped view of the `events` table, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

EVENTS_SQL = """
base as (select *, cast(regexp_extract(props, '[0-9]+') as bigint) as k,
         cast(user_id as varchar) || '-' || cast(cast(floor((day(ts) - 1) / 3) as bigint) as varchar) as session_id from events),
numbered as (select *, row_number() over (partition by session_id order by ts, event_id) - 1 as sequence,
             event_type in ('view', 'click') as is_call from base),
ev as (select 'e' || event_id as event_id, session_id, cast(sequence as bigint) as sequence, ts, k, user_id,
  case event_type when 'signup' then 'user_message' when 'view' then 'tool_call' when 'click' then 'tool_call' else 'tool_result' end as event_type,
  case event_type when 'view' then 'Read' when 'click' then 'Edit' end as tool_name,
  case event_type when 'view' then 'read' when 'click' then 'edit' end as file_operation,
  case when is_call then '/srv/p' || (user_id % 7) || '/src/f' || (k % 20) || '.py' end as file_path,
  case event_type when 'signup' then case k % 3 when 0 then 'please plan the next step for item ' when 1 then 'why does the parser drop tokens of item ' else 'design a database schema with item ' end || k when 'view' then 'Tool: Read' when 'click' then 'Tool: Edit'
    when 'purchase' then 'test ' || k || ' passed ok' else replace(replace(case k % 8 when 0 then 'error: item K failed in PATH' when 1 then 'Traceback (most recent call last):' || chr(10) || '  File "PATH", line K'
      when 2 then 'FAILED PATH::test_K' when 3 then 'ValueError: item K in PATH' when 4 then 'curl: (7) item K in PATH' when 5 then 'fatal: item K in PATH' when 6 then 'PATH: permission denied for item K' else 'error TS2304: item K in PATH' end,
      'PATH', '/srv/p' || (user_id % 7) || '/src/f' || (k % 20) || '.py'), 'K', k::varchar) end as content,
  case when event_type = 'click' then 'v' || (k % 5) end as old_content,
  case when event_type = 'click' then 'v' || (k % 5 + 1) end as new_content,
  case when event_type in ('purchase', 'error') then event_type = 'purchase' end as tool_success,
  event_type = 'error' as error_detected,
  case when event_type = 'error' then case when k % 3 = 0 then 'test' else 'bash' end end as error_category,
  case when is_call then 'e' || event_id when event_type in ('purchase', 'error')
    then last_value(case when is_call then 'e' || event_id end ignore nulls) over (partition by session_id order by ts, event_id rows between unbounded preceding and current row) end as tool_use_id,
  '/srv/p' || (user_id % 7) as cwd, 'model-' || (k % 3) as model from numbered)
"""

ASKED = ["please plan the next step for item ", "why does the parser drop tokens of item ", "design a database schema with item "]
FAILED = [
    "error: item K failed in PATH", 'Traceback (most recent call last):\n  File "PATH", line K', "FAILED PATH::test_K", "ValueError: item K in PATH",
    "curl: (7) item K in PATH", "fatal: item K in PATH", "PATH: permission denied for item K", "error TS2304: item K in PATH",
]


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup: message of the user; view, click: reading and editing calls; purchase, error: clean and failing results.

    A session is a user's three days.  One window, by session, gives sequence and the call that a result belongs to.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    session = F.concat_ws("-", "user_id", F.floor((F.dayofmonth("ts") - 1) / 3).cast("string"))
    order = W.partitionBy("session_id").orderBy("ts", "eid")
    kind, call = F.col("kind"), F.col("kind").isin("view", "click")
    result = kind.isin("purchase", "error")
    base = F.concat(F.lit("/srv/p"), F.col("user_id") % 7)
    path = F.concat(base, F.lit("/src/f"), F.col("k") % 20, F.lit(".py"))
    seen = raw.withColumns({"session_id": session, "eid": F.col("event_id")}).withColumn("event_id", F.concat(F.lit("e"), "event_id"))
    seen = seen.withColumns({"sequence": (F.row_number().over(order) - 1).cast("long"), "_call": F.last(F.when(call, F.col("event_id")), True).over(order.rowsBetween(W.unboundedPreceding, 0))})
    return seen.select(
        "event_id", "session_id", "sequence", "ts", "k", "user_id",
        F.when(kind == "signup", "user_message").when(call, "tool_call").otherwise("tool_result").alias("event_type"),
        F.when(kind == "view", "Read").when(kind == "click", "Edit").alias("tool_name"),
        F.when(kind == "view", "read").when(kind == "click", "edit").alias("file_operation"),
        F.when(call, path).alias("file_path"),
        F.when(kind == "signup", F.concat(F.element_at(F.array(*map(F.lit, ASKED)), (F.col("k") % 3 + 1).cast("int")), "k")).when(kind == "view", "Tool: Read").when(kind == "click", "Tool: Edit")
        .when(kind == "purchase", F.concat(F.lit("test "), "k", F.lit(" passed ok"))).otherwise(F.replace(F.replace(F.element_at(F.array(*map(F.lit, FAILED)), (F.col("k") % 8 + 1).cast("int")), F.lit("PATH"), path), F.lit("K"), F.col("k").cast("string"))).alias("content"),
        F.when(kind == "click", F.concat(F.lit("v"), F.col("k") % 5)).alias("old_content"),
        F.when(kind == "click", F.concat(F.lit("v"), F.col("k") % 5 + 1)).alias("new_content"),
        F.when(result, kind == "purchase").alias("tool_success"), (kind == "error").alias("error_detected"),
        F.when(kind == "error", F.when(F.col("k") % 3 == 0, "test").otherwise("bash")).alias("error_category"),
        F.when(call, F.col("event_id")).when(result, F.col("_call")).alias("tool_use_id"), base.alias("cwd"), F.concat(F.lit("model-"), F.col("k") % 3).alias("model"),
    )
