"""ST3: streaming task-time summary - tumbling event-time windows over the
stream of completed tasks (the paired timers), append mode with watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_time_summary_stream(pairs: DataFrame, task_col: str = "task", window: str = "1 day",
                             delay: str = "1 hour") -> DataFrame:
    return (pairs.withWatermark("stop_ts", delay)
            .groupBy(F.window("stop_ts", window).alias("w"), task_col)
            .agg(F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"),
                 F.count(F.lit(1)).alias("n")))
