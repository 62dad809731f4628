"""Timer pairing (A-T1) and the exact distributed helpers (both paths)."""

from pyspark.sql import functions as F

from rankwise.operators import timing


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string") \
        .withColumn("ts", F.to_timestamp("ts"))


def test_pairing_semantics(spark):
    rows = [(1, "2024-01-01 00:00:00", 7, "purchase"),       # stop without start
            (2, "2024-01-01 00:00:10", 7, "click"),
            (3, "2024-01-01 00:00:20", 7, "click"),           # overwrites
            (4, "2024-01-01 00:00:30.5", 7, "purchase"),      # pairs with 3, 10.5 s -> 11
            (5, "2024-01-01 00:00:40", 7, "purchase")]        # stop without start
    pairs, rej = timing.pair_timers(_events(spark, rows), "user_id", "event_type", "click", "purchase")
    assert [(r["start_id"], r["stop_id"], r["seconds"]) for r in pairs.collect()] == [(3, 4, 11)]
    assert sorted(r["stop_id"] for r in rej.collect()) == [1, 5]
