"""Timer pairing (A-T1) and elapsed times.

A start stores the time per (task, id) - a second start overwrites it; a
stop takes the stored start and removes it; a stop without a stored start
is an error.  As a relational plan: number the stops of each key (running
count, exact and split over tasks for hot keys), then the start of a stop
is the latest start of its segment - a ``groupBy`` aggregate, not a
per-key scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.functions.columns import elapsed_seconds_ceil
from rankwise.operators.ranking import prefix_count


def pair_timers(events: DataFrame, key: str, kind_col: str, start_value: str, stop_value: str,
                ts_col: str = "ts", id_col: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Returns ``(pairs, rejects)``.

    pairs: ``(key, start_id, stop_id, start_ts, stop_ts, seconds)``;
    rejects: stops without a stored start ``(key, stop_id, stop_ts, reason)``.
    """
    ev = (events.filter(F.col(kind_col).isin(start_value, stop_value))
          .select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), F.col(ts_col).alias("_ts"),
                  (F.col(kind_col) == stop_value).alias("_stop")))
    seg = prefix_count(ev, ["_key"], ["_ts", "_id"], F.col("_stop"), "_seg")
    # a segment holds the starts after the previous stop and at most one stop
    # (the one that closes it): one aggregate finds both, no join
    ev_key = F.struct("_ts", "_id")
    segs = seg.groupBy("_key", "_seg").agg(
        F.max_by(F.when(~F.col("_stop"), ev_key), F.when(~F.col("_stop"), ev_key)).alias("_start"),
        F.max_by(F.when(F.col("_stop"), ev_key), F.when(F.col("_stop"), ev_key)).alias("_end"))
    stops = segs.filter(F.col("_end").isNotNull())
    pairs = stops.filter(F.col("_start").isNotNull()).select(
        F.col("_key").alias(key), F.col("_start._id").alias("start_id"), F.col("_end._id").alias("stop_id"),
        F.col("_start._ts").alias("start_ts"), F.col("_end._ts").alias("stop_ts"),
        elapsed_seconds_ceil(F.col("_start._ts"), F.col("_end._ts")).alias("seconds"))
    rejects = stops.filter(F.col("_start").isNull()).select(
        F.col("_key").alias(key), F.col("_end._id").alias("stop_id"), F.col("_end._ts").alias("stop_ts"),
        F.lit("stop_without_start").alias("reason"))
    return pairs, rejects


def task_time_summary(pairs: DataFrame, task_col: str, window: str = "1 day") -> DataFrame:
    """ST3 batch form: mean / max seconds per task and tumbling window."""
    return (pairs.groupBy(F.window("stop_ts", window).alias("w"), task_col)
            .agg(F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"),
                 F.count(F.lit(1)).alias("n")))
