"""Score aggregation: clamp, category means, weighted total, decision, ranking.

Input is the long score table ``(job_id, candidate_id, type, kind, score)``
(one row per answered requirement).  Every step is a ``groupBy`` with
map-side partial aggregation; the only broadcast is the 12-row
requirement-type dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwise.functions.columns import clamp
from rankwise.operators.ranking import Key, asc, desc, rank_within
from rankwise.schemas import KIND_MANDATORY, MAX_SCORE, MIN_SCORE

KEYS = ["job_id", "candidate_id"]
DIGITS = 9


def clamp_scores(scores: DataFrame, raw: str = "raw_score", lo: int = MIN_SCORE, hi: int = MAX_SCORE) -> DataFrame:
    """Clamp raw answers into the score range (``score`` column)."""
    return scores.withColumn("score", clamp(F.col(raw), lo, hi).cast("int"))


def score_range_violations(scores: DataFrame, lo: int = MIN_SCORE, hi: int = MAX_SCORE) -> DataFrame:
    """Scores outside the range that would reach the total (must be empty)."""
    return scores.filter((F.col("score") < lo) | (F.col("score") > hi) | F.col("score").isNull())


def assert_scores_in_range(scores: DataFrame, lo: int = MIN_SCORE, hi: int = MAX_SCORE) -> DataFrame:
    """P8 strict mode: the query fails at run time on an out-of-range score."""
    ok = F.col("score").between(lo, hi)
    return scores.withColumn("score", F.when(F.assert_true(ok, F.lit("score out of range")).isNull(),
                                             F.col("score")))


def category_stats(scores: DataFrame, lo: int = MIN_SCORE) -> DataFrame:
    """One pass over the score table: per (job, candidate, type) the exact sum
    and count of all scores and of the mandatory ones.  Totals, decision and
    pivot all read this one aggregate (one shuffle, reused)."""
    mand = F.col("kind") == KIND_MANDATORY
    return (scores.groupBy(*KEYS, "type")
            .agg(F.sum(F.col("score").cast("bigint") - lo).alias("sum_above_min"),
                 F.count("score").alias("n_scores"),
                 F.sum(F.when(mand, F.col("score").cast("bigint"))).alias("mand_sum"),
                 F.count(F.when(mand, F.col("score"))).alias("mand_n")))


def category_means(scores: DataFrame, lo: int = MIN_SCORE, stats: DataFrame | None = None) -> DataFrame:
    """A1: mean score per (job, candidate, type); types without scores are absent.

    Keeps the exact integer sum and count so later steps divide once.
    """
    stats = stats if stats is not None else category_stats(scores, lo)
    return stats.withColumn("mean_score", F.col("sum_above_min") / F.col("n_scores") + F.lit(lo))


def weighted_totals(scores: DataFrame, types: DataFrame, candidates: DataFrame | None = None,
                    lo: int = MIN_SCORE, stats: DataFrame | None = None) -> DataFrame:
    """A3: ``min + sum_t mean_t(score - min) * w_t / sum_{present t} w_t``.

    ``candidates`` (job_id, candidate_id) lets a candidate without any
    score appear with total ``min`` (left join), as the reference does.
    The weights are the 12-row type dimension (broadcast, fixed size).
    Totals are rounded to ``DIGITS`` decimals: equal totals then tie, in
    whatever order their parts were added.
    """
    stats = stats if stats is not None else category_stats(scores, lo)
    weights = F.broadcast(types.select("type", F.col("weighting").cast("double").alias("w")))
    means = stats.join(weights, "type", "inner")
    totals = (means.groupBy(*KEYS)
              .agg(F.sum(F.col("sum_above_min") / F.col("n_scores") * F.col("w")).alias("_num"),
                   F.sum("w").alias("_den"),
                   F.min(F.when(F.col("mand_n") > 0, F.col("mand_sum") / F.col("mand_n"))).alias("mandatory_floor"))
              .withColumn("total_score", _total(lo))
              .drop("_num", "_den"))
    if candidates is not None:
        totals = (candidates.select(*KEYS).distinct().join(totals, KEYS, "left")
                  .withColumn("total_score", F.coalesce("total_score", F.lit(float(lo)))))
    return totals


def _total(lo: int) -> Column:
    return F.round(F.lit(float(lo)) + F.col("_num") / F.col("_den"), DIGITS)


def mandatory_floor(scores: DataFrame) -> DataFrame:
    """Lowest per-type mean over mandatory requirements (null if none)."""
    st = category_stats(scores)
    return (st.groupBy(*KEYS).agg(F.min(F.when(F.col("mand_n") > 0, F.col("mand_sum") / F.col("mand_n")))
                                  .alias("mandatory_floor")))


def decide_promising(totals: DataFrame, scores: DataFrame | None = None, total_threshold: float = 50.0,
                     mandatory_threshold: float = 25.0) -> DataFrame:
    """X23 (native rule): promising = total >= t and every mandatory type mean >= m.

    ``totals`` from ``weighted_totals`` already carry ``mandatory_floor``."""
    if "mandatory_floor" not in totals.columns:
        totals = totals.join(mandatory_floor(scores), KEYS, "left")
    return (totals.withColumn("promising", (F.col("total_score") >= total_threshold)
                              & F.coalesce(F.col("mandatory_floor") >= mandatory_threshold, F.lit(True)))
            .drop("mandatory_floor"))


def category_pivot(scores: DataFrame, type_names: list[str], lo: int = MIN_SCORE,
                   stats: DataFrame | None = None) -> DataFrame:
    """A2: one ``score (<type>)`` column per configured type (explicit value list).

    A (job, candidate, type) has one mean, so a ``max`` per type is the pivot: one aggregate of plain doubles."""
    means = category_means(scores, lo, stats)
    return means.groupBy(*KEYS).agg(*[F.max(F.when(F.col("type") == t, F.col("mean_score"))).alias(f"score ({t})") for t in type_names])


def ranking_order() -> list[Key]:
    """O1: promising first, then total descending; candidate id as the tie rule."""
    return [desc("promising"), desc("total_score"), asc("candidate_id")]


def rank_candidates(overview: DataFrame) -> DataFrame:
    """O1 + W1: place 1..n per job, without a one-task window on hot jobs."""
    return rank_within(overview, ["job_id"], ranking_order(), name="place")


def overview(scores: DataFrame, types: DataFrame, type_names: list[str], total_threshold: float = 50.0,
             mandatory_threshold: float = 25.0, lo: int = MIN_SCORE, candidates: DataFrame | None = None) -> DataFrame:
    """S8 frame: candidate, place, promising, total_score, score (<type>)...

    Two aggregates in a row: per (job, candidate, type) the exact sums, then
    per (job, candidate) the weighted total, the mandatory floor and the
    pivoted type means together - one shuffle each, no join between them.
    ``candidates`` (job_id, candidate_id) brings in candidates without any
    score: total ``lo``, empty type means."""
    stats = category_stats(scores, lo)
    weights = F.broadcast(types.select("type", F.col("weighting").cast("double").alias("w")))
    mean = F.col("sum_above_min") / F.col("n_scores")
    per = (stats.join(weights, "type")
           .groupBy(*KEYS)
           .agg(F.sum(mean * F.col("w")).alias("_num"), F.sum("w").alias("_den"),
                F.min(F.when(F.col("mand_n") > 0, F.col("mand_sum") / F.col("mand_n"))).alias("mandatory_floor"),
                *[F.max(F.when(F.col("type") == t, mean + F.lit(lo))).alias(f"score ({t})") for t in type_names])
           .withColumn("total_score", _total(lo))
           .drop("_num", "_den"))
    if candidates is not None:
        per = (candidates.select(*KEYS).distinct().join(per, KEYS, "left")
               .withColumn("total_score", F.coalesce("total_score", F.lit(float(lo)))))
    decided = decide_promising(per, None, total_threshold, mandatory_threshold)
    cols = [*KEYS, "total_score", "promising", *[f"score ({t})" for t in type_names]]
    return rank_candidates(decided.select(*[F.col(f"`{c}`") for c in cols]))
