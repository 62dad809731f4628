"""Operators the text describes but the reference code does not implement
(optional D1-D6): rank-biased overlap, keyword distance, token and cost
estimates, coarse-to-fine shortlist, weight presets, knock-out and fading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwise.functions.text import tokens
from rankwise.operators.native_scorer import overlap_scores
from rankwise.operators.ranking import desc, prefix_count, rank_within


def rank_biased_overlap(ballots: DataFrame, reference: DataFrame, p: float) -> DataFrame:
    """``(1 - p) * sum_{d=1..K} p^(d-1) * |A[:d] & B[:d]| / d`` per ballot
    against the job's reference ranking, K = the job's ranking depth.

    ``|A[:d] & B[:d]|`` is the number of elements whose larger place is at
    most ``d``: element rows (key = larger place) and depth rows (key = d) are
    ordered together and a running count of element rows is read at every
    depth row (``prefix_count``: exact, and split over tasks for a hot job).
    No position pairs, no window over a whole job.
    """
    a = ballots.select("job_id", "rater", "candidate", F.col("place").alias("pa"))
    b = reference.select("job_id", "candidate", F.col("place").alias("pb"))
    elems = (a.join(b, ["job_id", "candidate"])
             .select("job_id", "rater", F.greatest("pa", "pb").alias("key"), F.lit(0).alias("kind")))
    depth = (ballots.groupBy("job_id", "rater").agg(F.max("place").alias("_k"))
             .join(reference.groupBy("job_id").agg(F.max("place").alias("_k2")), "job_id")
             .select("job_id", "rater", F.greatest("_k", "_k2").alias("k")))
    depths = depth.select("job_id", "rater", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("key"),
                          F.lit(1).alias("kind"))
    both = elems.unionByName(depths)
    counted = prefix_count(both, ["job_id", "rater"], ["key", "kind"], F.col("kind") == 0, "_ov")
    terms = counted.filter(F.col("kind") == 1).select(
        "job_id", "rater", (F.pow(F.lit(p), F.col("key") - 1) * F.col("_ov") / F.col("key")).alias("t"))
    return terms.groupBy("job_id", "rater").agg(((1 - p) * F.sum("t")).alias("rbo"))


def keyword_distance(candidates: DataFrame, requirements: DataFrame, text_col: str = "text",
                     spec_col: str = "specification") -> DataFrame:
    """Euclidean distance between the binary bag-of-words vector of a
    document and that of its job's keyword list = ``sqrt(|D| + |K| - 2|D&K|)``
    (word sets; a join, no vocabulary cap)."""
    dw = candidates.select("job_id", "candidate_id", F.explode(F.array_distinct(tokens(text_col))).alias("w"))
    kw = requirements.select("job_id", F.explode(tokens(spec_col)).alias("w")).distinct()
    d_n = dw.groupBy("job_id", "candidate_id").agg(F.count(F.lit(1)).alias("nd"))
    k_n = kw.groupBy("job_id").agg(F.count(F.lit(1)).alias("nk"))
    both = dw.join(kw, ["job_id", "w"]).groupBy("job_id", "candidate_id").agg(F.count(F.lit(1)).alias("nb"))
    base = candidates.select("job_id", "candidate_id").join(d_n, ["job_id", "candidate_id"], "left")
    out = (base.join(k_n, "job_id", "left").join(both, ["job_id", "candidate_id"], "left")
           .na.fill(0, ["nd", "nk", "nb"]))
    return out.select("job_id", "candidate_id", F.sqrt(F.col("nd") + F.col("nk") - 2 * F.col("nb")).alias("distance"))


def token_estimate(chars: Column, chars_per_token: int = 4) -> Column:
    """D3: tokens ~ characters / 4, rounded up."""
    return F.ceil(chars / F.lit(chars_per_token)).cast("bigint")


def cost_estimate(requests: DataFrame, chars_col: str, price_per_million: float, context_tokens: int,
                  by: str = "job_id") -> DataFrame:
    """D3: tokens and cost per group plus the number of requests that exceed
    the context window."""
    t = requests.withColumn("_tok", token_estimate(F.col(chars_col)))
    return t.groupBy(by).agg(F.count(F.lit(1)).alias("n_requests"), F.sum("_tok").alias("input_tokens"),
                             (F.sum("_tok") * price_per_million / 1e6).alias("cost"),
                             F.count_if(F.col("_tok") > context_tokens).alias("over_context"))


def shortlist(scores: DataFrame, k: int) -> DataFrame:
    """Coarse-to-fine - the k best candidates per job by their mean cheap
    score (ties by id); the limit is the feature (a top-k shortlist)."""
    mean = scores.groupBy("job_id", "candidate_id").agg((F.sum("score") / F.count("score")).alias("mean_score"))
    ranked = rank_within(mean, ["job_id"], [desc("mean_score"), "candidate_id"], name="rank")
    return ranked.filter(F.col("rank") <= k)


def coarse_scores(requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """``job_id, candidate_id, coarse`` for every candidate: each word of a job's requirements weighs a millionth part of
    its requirements' words, a document gets the weights of the words it holds (0 without any).

    Distinct words meet the words of their job only, whole numbers are summed;
    no positions, no n-grams and no pairs with requirements."""
    spec = requirements.select("job_id", "requirement_id", F.array_distinct(tokens("specification")).alias("_t"))
    weights = (spec.select("job_id", F.floor(F.lit(1_000_000) / F.greatest(F.size("_t"), F.lit(1))).alias("_w"), F.explode("_t").alias("token"))
               .groupBy("job_id", "token").agg(F.sum("_w").alias("_w")))
    words = candidates.select("job_id", "candidate_id", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    found = words.join(weights, ["job_id", "token"]).groupBy("job_id", "candidate_id").agg(F.sum("_w").alias("coarse"))
    return (candidates.select("job_id", "candidate_id").distinct().join(found, ["job_id", "candidate_id"], "left")
            .withColumn("coarse", F.coalesce("coarse", F.lit(0)).cast("bigint")))


def shortlist_coarse_to_fine(requirements: DataFrame, candidates: DataFrame, k: int, keep: int) -> DataFrame:
    """The ``k`` best candidates of each job, where only the ``keep`` best by ``coarse_scores`` (ties by id) are scored in full.

    Both limits are the feature: a shortlist for less work.  A candidate that
    the coarse score doesn't keep can't be on it, so it is not exact; with
    ``keep`` as large as the job it equals scoring all."""
    kept = rank_within(coarse_scores(requirements, candidates), ["job_id"], [desc("coarse"), "candidate_id"], name="_r").filter(F.col("_r") <= keep)
    fine = overlap_scores(requirements, candidates.join(kept, ["job_id", "candidate_id"], "left_semi"))
    return shortlist(fine, k)


def knocked_out(scores: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose mean on some mandatory requirement type is below
    the threshold (a knock-out criterion)."""
    m = (scores.filter(F.col("kind") == "mandatory").groupBy("job_id", "candidate_id", "type")
         .agg((F.sum("score") / F.count("score")).alias("m")))
    return (m.groupBy("job_id", "candidate_id").agg(F.min("m").alias("lowest_mandatory"))
            .filter(F.col("lowest_mandatory") < threshold))


def fading_weight(years: Column, half_life_years: float) -> Column:
    """Weight of experience that lies ``years`` back: ``exp(-years / h)``."""
    return F.exp(-years / F.lit(half_life_years))
