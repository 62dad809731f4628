"""Conversation (C1-C4) and timing (A-T1, X2, X6, ST3 batch form) queries
on ``conversations`` (F6) and ``events`` (F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwise.functions.columns import ballot_timestamp
from rankwise.operators import conversations as cv, timing
from rankwise.plans.oracle import strip_sql
from rankwise.plans.registry import register
from rankwise.sources.tables import table

_ST = strip_sql("text")


@register("history_without_system", """
SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'""")
def q_history_without_system(spark, sf_dir):
    return cv.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@register("single_context_check", """
SELECT conv_id, CAST(count(*) FILTER (WHERE role = 'system') AS BIGINT) AS n_system, arg_min(role, turn) AS first_role,
       count(*) FILTER (WHERE role = 'system') = 1 AND arg_min(role, turn) = 'system' AS valid
FROM conversations GROUP BY ALL""")
def q_single_context_check(spark, sf_dir):
    c = cv.context_check(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.col("n_system").cast("bigint").alias("n_system"), "first_role", "valid")


def _layout_sql(role_case: str) -> str:
    return f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
       md5(string_agg(({role_case}) || chr(31) || {_ST}, chr(30) ORDER BY turn)) AS messages_md5,
       count(*) FILTER (WHERE ({role_case}) IS NULL) = 0 AS valid
FROM conversations GROUP BY ALL"""


@register("chat_layout_roles", _layout_sql(
    "CASE WHEN role IN ('user', 'system', 'assistant') THEN role END"))
def q_chat_layout_roles(spark, sf_dir):
    o = cv.layout_roles(table(spark, sf_dir, "conversations"))
    return o.select("conv_id", F.col("n_messages").cast("bigint").alias("n_messages"),
                    F.md5("messages").alias("messages_md5"), "valid")


@register("chat_layout_user_model", _layout_sql(
    "CASE WHEN role IN ('user', 'system') THEN 'user' WHEN role = 'assistant' THEN 'model' END"))
def q_chat_layout_user_model(spark, sf_dir):
    o = cv.layout_user_model(table(spark, sf_dir, "conversations"))
    return o.select("conv_id", F.col("n_messages").cast("bigint").alias("n_messages"),
                    F.md5("messages").alias("messages_md5"), "valid")


@register("chat_layout_instruction", f"""
WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS n_system,
                  arg_min({_ST}, turn) FILTER (WHERE role = 'system') AS system_prompt FROM conversations GROUP BY ALL),
p AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '[INST] ' || {_ST} || ' [/INST]' ELSE {_ST} END,
                                 chr(10) ORDER BY turn) AS prompt
      FROM conversations WHERE role <> 'system' GROUP BY ALL)
SELECT c.conv_id, md5(c.system_prompt) AS system_md5, md5(p.prompt) AS prompt_md5,
       CASE WHEN c.n_system <> 1 THEN 'context_count' END AS error
FROM c LEFT JOIN p USING (conv_id)""")
def q_chat_layout_instruction(spark, sf_dir):
    o = cv.layout_instruction(table(spark, sf_dir, "conversations"))
    return o.select("conv_id", F.md5("system_prompt").alias("system_md5"), F.md5("prompt").alias("prompt_md5"),
                    "error")


@register("message_records", f"""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' WHEN role IN ('user', 'system') THEN role END AS author,
       md5({_ST}) AS text_md5 FROM conversations""")
def q_message_records(spark, sf_dir):
    m = cv.message_records(table(spark, sf_dir, "conversations"))
    return m.select("conv_id", "turn", "author", F.md5("text").alias("text_md5"))


@register("message_times", """
WITH m AS (SELECT user_id AS conv_id, event_id AS turn, event_type, epoch_us(ts) AS us FROM events)
SELECT conv_id, turn, CASE WHEN event_type = 'click' THEN 'user' WHEN event_type = 'purchase' THEN 'model' ELSE 'system' END AS author,
       event_type AS text, CAST(us AS BIGINT) AS created_us,
       CAST(ceil((us - lag(us) OVER (PARTITION BY conv_id ORDER BY turn)) / 1000000.0) AS BIGINT) AS elapsed FROM m""")
def q_message_times(spark, sf_dir):
    """C4 with times: events as the messages of their user; seconds since the message before, rounded up."""
    role = F.when(F.col("event_type") == "click", F.lit("user")).when(F.col("event_type") == "purchase", F.lit("assistant")).otherwise(F.lit("system"))
    said = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"),
                                                 F.concat(F.lit(" "), "event_type", F.lit("\u00a0")).alias("text"), "ts")
    m = cv.message_records(said, "ts")
    return m.select("conv_id", "turn", "author", "text", F.unix_micros("created").alias("created_us"), "elapsed")


TIMER_SQL = """
ev AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS is_stop FROM events WHERE event_type IN ('click', 'purchase')),
seg AS (SELECT *, coalesce(sum(CAST(is_stop AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sg FROM ev),
st AS (SELECT user_id, sg, arg_max(event_id, (ts, event_id)) AS start_id, max(ts) AS start_ts
       FROM seg WHERE NOT is_stop GROUP BY ALL),
paired AS (SELECT s.user_id, st.start_id, s.event_id AS stop_id, st.start_ts, s.ts AS stop_ts
           FROM seg s LEFT JOIN st USING (user_id, sg) WHERE s.is_stop)"""


@register("timer_pairs", f"""WITH {TIMER_SQL}
SELECT user_id, start_id, stop_id, CAST(ceil((epoch_us(stop_ts) - epoch_us(start_ts)) / 1000000.0) AS BIGINT) AS seconds,
       CAST(epoch_us(stop_ts) - epoch_us(start_ts) AS BIGINT) AS elapsed_us
FROM paired WHERE start_id IS NOT NULL""")
def q_timer_pairs(spark, sf_dir):
    """A-T1 + X6 + C4 (elapsed = after - before) on F7: click starts, purchase stops."""
    pairs, _ = timing.pair_timers(table(spark, sf_dir, "events"), "user_id", "event_type", "click", "purchase")
    return pairs.select("user_id", "start_id", "stop_id", "seconds",
                        F.timestamp_diff("MICROSECOND", "start_ts", "stop_ts").alias("elapsed_us"))


@register("timer_rejects", f"""WITH {TIMER_SQL}
SELECT user_id, stop_id, 'stop_without_start' AS reason FROM paired WHERE start_id IS NULL""")
def q_timer_rejects(spark, sf_dir):
    _, rej = timing.pair_timers(table(spark, sf_dir, "events"), "user_id", "event_type", "click", "purchase")
    return rej.select("user_id", "stop_id", "reason")


@register("task_time_summary", f"""WITH {TIMER_SQL},
p AS (SELECT *, CAST(ceil((epoch_us(stop_ts) - epoch_us(start_ts)) / 1000000.0) AS BIGINT) AS seconds
      FROM paired WHERE start_id IS NOT NULL)
SELECT strftime(date_trunc('day', stop_ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'purchase' AS task,
       round(avg(seconds), 6) AS mean_seconds, max(seconds) AS max_seconds, CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY ALL""")
def q_task_time_summary(spark, sf_dir):
    """ST3 in batch form: tumbling one-day windows over the paired timers."""
    pairs, _ = timing.pair_timers(table(spark, sf_dir, "events"), "user_id", "event_type", "click", "purchase")
    s = timing.task_time_summary(pairs.withColumn("task", F.lit("purchase")), "task")
    return s.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "task",
                    F.round("mean_seconds", 6).alias("mean_seconds"), "max_seconds",
                    F.col("n").cast("bigint").alias("n"))


@register("ballot_timestamps", """
SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch_seconds FROM events""")
def q_ballot_timestamps(spark, sf_dir):
    """Event times written in the questionnaire format (``yyyy/MM/dd h:mm:ss a GMT+1``)
    and parsed back."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy/MM/dd h:mm:ss a"), F.lit(" GMT+1"))
    return e.select("event_id", F.unix_timestamp(ballot_timestamp(text)).cast("bigint").alias("epoch_seconds"))
