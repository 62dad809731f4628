"""Consensus of several ballots of a job: majority set and mean ranking.

All steps are ``groupBy`` aggregates (map-side combine) keyed by
``(job_id, candidate)``; the first-seen mode uses ``max_by`` over a
``(count, -first_rater)`` key instead of a window, so no group is gathered
into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.operators.ranking import rank_within
from rankwise.schemas import CONSENSUS_ENTITY


def ballots_per_job(ballots: DataFrame) -> DataFrame:
    return ballots.groupBy("job_id").agg(F.count_distinct("rater").alias("n_ballots"))


def majority_set(ballots: DataFrame) -> DataFrame:
    """A4: ``(job_id, candidate, votes, n_ballots, in_majority)``; a candidate is in
    the set when it is promising on strictly more than half of the ballots."""
    votes = ballots.groupBy("job_id", "candidate").agg(F.count_if("promising").alias("votes"))
    return (votes.join(ballots_per_job(ballots), "job_id")
            .withColumn("in_majority", F.col("votes") * 2 > F.col("n_ballots")))


def first_seen_mode(ballots: DataFrame) -> DataFrame:
    """Most frequent place per (job, candidate); ties go to the value seen
    first in rater order (``statistics.mode`` semantics)."""
    per_value = (ballots.groupBy("job_id", "candidate", "place")
                 .agg(F.count(F.lit(1)).alias("_cnt"), F.min("rater_ord").alias("_first")))
    return (per_value.groupBy("job_id", "candidate")
            .agg(F.max_by("place", F.struct(F.col("_cnt"), -F.col("_first"))).alias("mode_place")))


def place_stats(ballots: DataFrame) -> DataFrame:
    """Mean (as exact sum / count), min, max and first-seen key per (job, candidate).

    W3: first seen = earliest (rater_ord, pos) at which the candidate occurs;
    ``pos`` is the ballot slot, or the candidate name when absent.
    """
    pos = F.col("pos") if "pos" in ballots.columns else F.col("candidate")
    stats = (ballots.groupBy("job_id", "candidate")
             .agg(F.sum("place").alias("place_sum"), F.count(F.lit(1)).alias("place_n"),
                  F.min("place").alias("min_place"), F.max("place").alias("max_place"),
                  F.min(F.struct(F.col("rater_ord"), pos)).alias("first_seen")))
    return (stats.withColumn("mean_place", F.col("place_sum") / F.col("place_n"))
            .join(first_seen_mode(ballots), ["job_id", "candidate"]))


def consensus_ranking(ballots: DataFrame) -> DataFrame:
    """A5 + O2 + W1: order by mean, mode, min, max (all ascending), ties by first
    seen; place = position in that order."""
    stats = place_stats(ballots)
    order = ["mean_place", "mode_place", "min_place", "max_place", "first_seen"]
    return rank_within(stats, ["job_id"], order, name="place")


def consensus_ballots(ballots: DataFrame) -> DataFrame:
    """A4 + A5 as one ballot per job with entity ``consensus``."""
    ranked = consensus_ranking(ballots)
    maj = majority_set(ballots).select("job_id", "candidate", F.col("in_majority").alias("promising"))
    return (ranked.join(maj, ["job_id", "candidate"])
            .select("job_id", F.lit(CONSENSUS_ENTITY).alias("rater"), F.lit(-1).alias("rater_ord"),
                    "candidate", "place", "promising"))


def consensus_header(headers: DataFrame) -> DataFrame:
    """Mean minutes per job (exact sum / count)."""
    return headers.groupBy("job_id").agg((F.sum("minutes") / F.count("minutes")).alias("mean_minutes"))
