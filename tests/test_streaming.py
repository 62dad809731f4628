"""Streaming equals batch (ST1, ST2)."""

import glob
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rankwise.operators import native_scorer as ns, timing
from rankwise.plans import q_front, q_streaming
from rankwise.streaming.incremental import start_incremental_scoring
from rankwise.streaming.timers import pair_timers_stream

from conftest import SF_SMALL


def test_incremental_scoring_two_arrivals(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("candidate_id"), "text")
    reqs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("job_id"),
        F.col("item_id").alias("requirement_id"), F.col("text").alias("specification"))
    arrive = f"{tmp_dir}/arrive"
    docs.filter("candidate_id < 100").write.parquet(f"{arrive}/b1")
    schema = docs.schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(arrive)
    start_incremental_scoring(spark, stream, reqs, f"{tmp_dir}/out", f"{tmp_dir}/ckpt").awaitTermination()
    # second arrival repeats some documents: they must not be scored twice
    docs.filter("candidate_id >= 50").write.parquet(f"{arrive}/b2")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(arrive)
    start_incremental_scoring(spark, stream, reqs, f"{tmp_dir}/out", f"{tmp_dir}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/out").select("job_id", "requirement_id", "candidate_id", "score")
    want = ns.overlap_scores(reqs, docs).select("job_id", "requirement_id", "candidate_id", "score")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_timer_stream_equals_batch(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = f"{tmp_dir}/events"
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    ev.limit(1).select(*[F.lit({"ts": "2200-01-01", "user_id": "-1", "event_type": "click"}[f.name]).cast(f.dataType).alias(f.name)
                         if f.name in ("ts", "user_id", "event_type") else F.col(f.name) for f in ev.schema]
                       ).write.mode("append").parquet(src)
    out = pair_timers_stream(stream)
    q = (out.writeStream.format("parquet").option("path", f"{tmp_dir}/pairs")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/pairs")
    pairs, rej = timing.pair_timers(ev, "user_id", "event_type", "click", "purchase")
    a = sorted((r["start_id"], r["stop_id"], r["seconds"]) for r in got.filter("reason IS NULL").collect())
    b = sorted((r["start_id"], r["stop_id"], r["seconds"]) for r in pairs.collect())
    assert a == b
    assert got.filter("reason IS NOT NULL").count() == rej.count()


def _run(spark, tmp_dir, rows, cuts, **options):
    """The stream over one file per cut, then a file that takes the watermark far ahead."""
    import uuid
    base = f"{tmp_dir}/{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [[(10**9, datetime(2030, 1, 1), -1, "click")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/p{i}")
        os.utime(next(p for p in glob.glob(f"{base}/in/p{i}/part-*")), (1_000_000 + i, 1_000_000 + i))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{base}/in"))
    q = (pair_timers_stream(stream, **options).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted(((r.user_id, r.start_id or 0, r.stop_id or 0, r.seconds or 0, r.reason or "")
                   for r in spark.read.parquet(f"{base}/out").collect()))


def _events(n, seed, jitter):
    r = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i, microseconds=r.randrange(10**6)), r.randrange(3), r.choice(["click", "purchase", "view"]))
            for i in range(n)]
    return sorted(rows, key=lambda x: x[1] + timedelta(minutes=r.uniform(0, jitter)))  # arrival order


def test_every_cut_gives_the_batch_rows(spark, tmp_dir):
    """Events arrive up to 50 minutes out of order, within the delay of an hour."""
    rows = _events(60, 1, 50)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    pairs, rej = timing.pair_timers(df, "user_id", "event_type", "click", "purchase")
    want = sorted([(r.user_id, r.start_id, r.stop_id, r.seconds, "") for r in pairs.collect()]
                  + [(r.user_id, 0, r.stop_id, 0, r.reason) for r in rej.collect()])
    for cuts in ([], [30], [7, 20, 21, 45]):
        assert _run(spark, tmp_dir, rows, cuts) == want


def test_a_stop_that_arrives_before_its_start(spark, tmp_dir):
    t = datetime(2024, 1, 1)
    rows = [(1, t + timedelta(minutes=30), 1, "click"), (2, t + timedelta(minutes=10), 1, "purchase"),
            (3, t + timedelta(hours=80), 1, "purchase")]
    assert _run(spark, tmp_dir, rows, [1]) == [(1, 0, 2, 0, "stop_without_start"), (1, 1, 3, 79 * 3600 + 1800, "")]


def test_expiry_does_not_depend_on_the_cut(spark, tmp_dir):
    t = datetime(2024, 1, 1)
    rows = [(1, t, 1, "click"), (2, t + timedelta(hours=5), 2, "click"), (3, t + timedelta(hours=30), 1, "purchase"),
            (4, t + timedelta(hours=31), 1, "click"), (5, t + timedelta(hours=32), 1, "purchase"), (6, t + timedelta(hours=40), 2, "click")]
    want = sorted([(1, 1, 0, 0, "expired"), (1, 0, 3, 0, "stop_without_start"), (1, 4, 5, 3600, ""), (2, 2, 0, 0, "expired"),
                   (2, 6, 0, 0, "expired")])
    for cuts in ([], [2], [1, 2, 3, 4, 5]):
        got = _run(spark, tmp_dir, rows, cuts, expiry_seconds=24 * 3600)
        assert got == want, cuts


def test_a_hot_user_in_many_batches(spark, tmp_dir):
    """One user with most events, over many micro-batches: the batch rows, and a state that shrinks again."""
    rows = _events(6000, 3, 40)
    rows = [(i, t, 0 if i % 10 else u, k) for i, t, u, k in rows]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    pairs, rej = timing.pair_timers(df, "user_id", "event_type", "click", "purchase")
    want = sorted([(r.user_id, r.start_id, r.stop_id, r.seconds, "") for r in pairs.collect()]
                  + [(r.user_id, 0, r.stop_id, 0, r.reason) for r in rej.collect()])
    assert _run(spark, tmp_dir, rows, [1000, 2000, 3000, 4500], slot_ms=60_000) == want


def test_scoring_repeats_inside_and_beyond_the_delay(spark, tmp_dir):
    """Repeats in one micro-batch, within the delay (state store) and long after it (table of keys): each document is scored once."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("candidate_id"), "text")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    reqs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("job_id"),
        F.col("item_id").alias("requirement_id"), F.col("text").alias("specification"))
    t0 = datetime(2024, 1, 1)
    ids = sorted(r.candidate_id for r in docs.collect())
    batches = [(0, ids[:20] + ids[:5]), (1, ids[10:30]), (300, ids[25:50]), (301, ids[:10]), (900, ids[5:60])]  # hours, ids
    for i, (hour, part) in enumerate(batches):
        some = spark.createDataFrame([(x, k) for k, x in enumerate(part)], "candidate_id long, k int")
        rows = docs.join(some, "candidate_id").withColumn("arrived", F.lit(t0 + timedelta(hours=hour)) + F.expr("make_interval(0, 0, 0, 0, 0, 0, k)"))
        rows.drop("k").coalesce(1).write.parquet(f"{tmp_dir}/in/p{i}")
        os.utime(glob.glob(f"{tmp_dir}/in/p{i}/part-*")[0], (1_000_000 + i, 1_000_000 + i))
    stream = (spark.readStream.schema(rows.drop("k").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{tmp_dir}/in"))
    q = start_incremental_scoring(spark, stream, reqs, f"{tmp_dir}/out", f"{tmp_dir}/ck", arrived="arrived", delay="24 hours")
    q.awaitTermination()
    keys = spark.read.parquet(f"{tmp_dir}/out_keys")
    assert keys.count() == keys.select("job_id", "candidate_id").distinct().count() == 60
    want = ns.overlap_scores(reqs, docs).select("job_id", "requirement_id", "candidate_id", "score")
    got = spark.read.parquet(f"{tmp_dir}/out").select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # the state store saw the repeat within the delay, the keys the others
    assert sum(op.get("customMetrics", {}).get("numDroppedDuplicateRows", 0) for p in q.recentProgress for op in p["stateOperators"]) >= 10


def test_tables_that_are_folders_of_files(spark, tmp_dir):
    """A large table is a folder: its stream reads every file of it."""
    for name in ("documents", "benchmark", "events"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(3).write.parquet(f"{tmp_dir}/{name}.parquet")
    got, want = q_streaming.q_stream_incremental_scores(spark, tmp_dir), q_front.q_native_scores(spark, tmp_dir)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    got, want = q_streaming.q_stream_timer_pairs(spark, tmp_dir), q_streaming.q_stream_timer_pairs(spark, SF_SMALL)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_timers_make_no_data_frames_and_ring_once(spark, tmp_dir):
    """Rows, not data frames, go through the state; a key's slots that are over are replayed by one timer, few or many."""
    from rankwise.streaming import timers
    stream = spark.readStream.schema(spark.read.parquet(f"{SF_SMALL}/events.parquet").schema).parquet(f"{SF_SMALL}/events.parque[t]")
    plan = pair_timers_stream(stream)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "InPandas" not in plan

    class Slots(dict):
        def iterator(self):
            return iter(self.items())
        getValue, removeKey, clear = dict.__getitem__, dict.pop, dict.clear
    for together in (1, timers.TOGETHER):
        timers.TOGETHER, kept = together, timers.TOGETHER
        try:
            p = timers._Pairing(None, 1000)
            p.slots = Slots({(s,): ([s], [s], [False]) for s in (7, 3, 5)})
            due, left = p._due(6000)
            assert ([*due], left) == ([[(3, 3, False)], [(5, 5, False)]], 7) and list(p.slots) == [(7,)]
            due, left = p._due(8000)
            assert ([*due], left) == ([[(7, 7, False)]], None) and not p.slots
        finally:
            timers.TOGETHER = kept


def test_a_null_key_is_a_key_of_its_own(spark, tmp_dir):
    t = datetime(2024, 1, 1)
    rows = [(u * 10 + k, t + timedelta(minutes=3 * k + u), None if u == 3 else u, "purchase" if k % 2 else "click") for k in range(4) for u in range(8)]
    got = [r for r in _run(spark, tmp_dir, [(i, x, -7 if u is None else u, k) for i, x, u, k in rows], [])]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    spark.createDataFrame([*rows, (10**9, datetime(2030, 1, 1), -1, "click")], schema).write.parquet(f"{tmp_dir}/in")
    q = (pair_timers_stream(spark.readStream.schema(schema).parquet(f"{tmp_dir}/in")).writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{tmp_dir}/out").collect()
    assert sorted((-7 if r.user_id is None else r.user_id, r.start_id, r.stop_id, r.seconds, "") for r in rows) == got
