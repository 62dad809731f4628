"""ST1: incremental scoring of newly arrived candidate documents.

``readStream`` over the arrival folder -> ``foreachBatch``.  Where arrivals carry
a time of arrival, repeats of a (job, candidate) within ``delay`` of each other are
dropped in the state store (``dropDuplicatesWithinWatermark``), which forgets a
key when the watermark has passed it; the time must be the clock of arrival, as
rows behind the watermark are dropped too.  Repeats within a micro-batch keep
the smallest text, and documents scored in any earlier micro-batch are removed
with a ``left_anti`` join against the keys of scored documents.  That table is
partitioned by a hash of the job; a micro-batch reads the parts of its own jobs
only.  What is left is written once (checkpoint) and scored against the job's
stored requirements (static side).  Each micro-batch writes its own
``epoch=<n>`` folder, scores first and keys second, and a repeated micro-batch
overwrites it: every (job, candidate) is scored once, whatever fails in between.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwise.operators.native_scorer import overlap_scores
from rankwise.operators.text import normalise_documents
from rankwise.session import checkpointed

KEYS = ["job_id", "candidate_id"]
#: Parts of the table of scored keys.
JOB_PARTS = 256


def _job_part() -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(JOB_PARTS)).cast("int")


def _scored_keys(spark: SparkSession, keys_dir: str, epoch_id: int, parts: list[int]) -> DataFrame | None:
    """Keys of earlier micro-batches in the given parts; None if none was written yet (any other failure is an error)."""
    try:
        keys = spark.read.parquet(keys_dir)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return keys.filter((F.col("epoch") < epoch_id) & F.col("job_part").isin(parts)).select(*KEYS)


def start_incremental_scoring(spark: SparkSession, arrivals: DataFrame, requirements: DataFrame, out_dir: str,
                              checkpoint_dir: str, available_now: bool = True, arrived: str | None = None,
                              delay: str = "1 day"):
    """Start the stream; ``arrivals`` is a streaming frame with
    ``(job_id, candidate_id, text)`` and maybe a time ``arrived``; returns the
    ``StreamingQuery``.  The keys of scored documents are kept beside the scores,
    in ``<out_dir>_keys``."""
    keys_dir = out_dir.rstrip("/") + "_keys"
    if arrived is not None:
        arrivals = arrivals.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(KEYS)

    def score_batch(batch: DataFrame, epoch_id: int) -> None:
        first = checkpointed(batch.groupBy(*KEYS).agg(F.min("text").alias("text")).withColumn("job_part", _job_part()))
        parts = [r.job_part for r in first.select("job_part").distinct().collect()]  # at most JOB_PARTS numbers
        scored = _scored_keys(batch.sparkSession, keys_dir, epoch_id, parts)
        new = first if scored is None else checkpointed(first.join(scored, KEYS, "left_anti"))
        scores = overlap_scores(requirements, normalise_documents(new, "text"))
        (scores.select("job_id", "requirement_id", "candidate_id", "hits", "total", "score")
         .write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}"))
        (new.select(*KEYS, "job_part").repartition("job_part").write.mode("overwrite").partitionBy("job_part")
         .parquet(f"{keys_dir}/epoch={epoch_id}"))

    writer = (arrivals.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
