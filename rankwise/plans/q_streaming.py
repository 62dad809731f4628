"""Streaming queries (ST1-ST3) run to completion with ``availableNow`` over
the given tables; the result folder is read back as a batch frame, so the
driver can compare it with the batch oracle (stream = batch)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from rankwise.plans import fixtures as fx
from rankwise.plans.q_chat import TIMER_SQL
from rankwise.plans.q_front import NATIVE_SQL
from rankwise.plans.registry import register
from rankwise.session import ensure_checkpoint_dir
from rankwise.streaming.incremental import start_incremental_scoring
from rankwise.streaming.summary import task_time_summary_stream
from rankwise.streaming.timers import pair_timers_stream


def _scratch(spark, name: str) -> str:
    """A fresh folder under the cluster's checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _table_stream(spark, sf_dir, name, schema):
    """A table as a stream, be it one file or a folder of files: the pattern has one match, and a plain path would have
    to be a folder."""
    return spark.readStream.schema(schema).parquet(os.path.join(sf_dir, f"{name}.parque[t]"))


def _events_stream(spark, sf_dir, base):
    """The events as a stream, and one closing record far in the future: rows come out when the watermark has
    passed them, and this start, of a user that doesn't exist, takes it past the last event."""
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("event_id", "ts", "user_id", "event_type").schema
    closing = base + "/closing_event"
    (spark.range(1).select(F.lit(-1).alias("event_id"), F.lit("2200-01-01").alias("ts"), F.lit(-1).alias("user_id"),
                           F.lit("click").alias("event_type"))
     .select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(closing))
    events = _table_stream(spark, sf_dir, "events", schema)
    return events.unionByName(spark.readStream.schema(schema).parquet(closing))


@register("stream_timer_pairs", f"""WITH {TIMER_SQL}
SELECT user_id, start_id, stop_id,
       CAST(ceil((epoch_us(stop_ts) - epoch_us(start_ts)) / 1000000.0) AS BIGINT) AS seconds
FROM paired WHERE start_id IS NOT NULL""")
def q_stream_timer_pairs(spark, sf_dir):
    """ST2: stateful pairing over the events stream (memory of pending starts
    per user); equals the batch pairing."""
    base = _scratch(spark, "timers")
    out = pair_timers_stream(_events_stream(spark, sf_dir, base))
    q = (out.writeStream.format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(base + "/out")
    return res.filter(F.col("reason").isNull()).select("user_id", "start_id", "stop_id", "seconds")


@register("stream_task_time_summary", f"""WITH {TIMER_SQL},
p AS (SELECT *, CAST(ceil((epoch_us(stop_ts) - epoch_us(start_ts)) / 1000000.0) AS BIGINT) AS seconds
      FROM paired WHERE start_id IS NOT NULL)
SELECT strftime(date_trunc('day', stop_ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'purchase' AS task,
       round(avg(seconds), 6) AS mean_seconds, max(seconds) AS max_seconds, CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY ALL""")
def q_stream_task_time_summary(spark, sf_dir):
    """ST3: the pairs of ST2 written as a stream are read as a stream and
    summarised in tumbling one-day windows (append mode, watermark).  A window
    comes out when the watermark has passed it, so one closing record far in
    the future follows the pairs; its own window stays open."""
    base = _scratch(spark, "summary")
    pairs = pair_timers_stream(_events_stream(spark, sf_dir, base))
    q1 = (pairs.writeStream.format("parquet").option("path", base + "/pairs")
          .option("checkpointLocation", base + "/ckpt1").outputMode("append").trigger(availableNow=True).start())
    q1.awaitTermination()
    schema = spark.read.parquet(base + "/pairs").schema
    done = (spark.readStream.schema(schema).parquet(base + "/pairs").filter(F.col("reason").isNull())
            .withColumn("task", F.lit("purchase")))
    closing = base + "/closing"
    (spark.range(1).select(F.lit("2200-01-01").cast("timestamp").alias("stop_ts"), F.lit(0).cast("long").alias("seconds"),
                           F.lit("closing").alias("task")).write.parquet(closing))
    end = spark.readStream.schema("stop_ts timestamp, seconds long, task string").parquet(closing)
    summary = task_time_summary_stream(done.select("stop_ts", "seconds", "task").unionByName(end), "task")
    q2 = (summary.writeStream.format("parquet").option("path", base + "/summary")
          .option("checkpointLocation", base + "/ckpt2").outputMode("append").trigger(availableNow=True).start())
    q2.awaitTermination()
    s = spark.read.parquet(base + "/summary")
    return s.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "task",
                    F.round("mean_seconds", 6).alias("mean_seconds"), "max_seconds",
                    F.col("n").cast("bigint").alias("n"))


@register("stream_incremental_scores", f"""WITH {NATIVE_SQL}
SELECT job_id, requirement_id, candidate_id, hits, total, score FROM native""")
def q_stream_incremental_scores(spark, sf_dir):
    """ST1: documents arrive as a stream and are scored once each against the
    stored requirements (static side); equals the batch scores."""
    base = _scratch(spark, "incremental")
    reqs, _ = fx.f_front(spark, sf_dir)
    schema = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).schema
    docs = _table_stream(spark, sf_dir, "documents", schema)
    inject = F.when(F.col("doc_id") % 2 == 0, F.lit(fx.NBSP)).otherwise(F.lit(fx.ZWSP))
    text = F.when(F.col("doc_id") % 10 == 0, F.regexp_replace(F.col("text"), "^([^ ]*) ",
                                                               F.concat(F.lit("$1"), inject)))
    arrivals = docs.select(F.col("source").alias("job_id"), F.col("doc_id").alias("candidate_id"),
                           F.coalesce(text, F.col("text")).alias("text"))
    q = start_incremental_scoring(spark, arrivals, reqs, base + "/out", base + "/ckpt")
    q.awaitTermination()
    return spark.read.parquet(base + "/out").select("job_id", "requirement_id", "candidate_id", "hits", "total",
                                                    F.col("score").cast("bigint").alias("score"))
