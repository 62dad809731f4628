"""Per-job and overall evaluation metrics (humans vs consensus vs model).

Inputs are long tables: human ballots, human headers (minutes), model
ballots, model run info (seconds).  Everything is joins on ``job_id`` and
``(job_id, candidate)`` plus ``groupBy`` aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwise.operators.agreement import BALLOT_COLS, compare_to_reference
from rankwise.operators.consensus import consensus_ballots, consensus_header
from rankwise.schemas import MODEL_ENTITY
from rankwise.session import checkpointed

JOB_METRIC_COLUMNS = [
    "human_hamming", "human_tau", "model_hamming", "model_tau",
    "model_ranking_better_or_equal", "model_categorization_better_or_equal", "time_savings",
    "candidates_filtered_by_model", "model_filter_accuracy", "candidates_filtered_by_humans",
    "human_filter_accuracy",
]


def model_as_ballot(model: DataFrame) -> DataFrame:
    """The model's result as one more ballot (entity ``model``)."""
    return model.select("job_id", F.lit(MODEL_ENTITY).alias("rater"), F.lit(1 << 30).alias("rater_ord"),
                        "candidate", "place", "promising")


def filter_accuracy(ballots: DataFrame, consensus: DataFrame) -> DataFrame:
    """A12 + A13 + J8 + U2 + U3: per ballot, rejected = all - promising and the
    share of the rejected that the consensus also left out; none rejected -> 0.0."""
    cons = consensus.select("job_id", "candidate", F.col("promising").alias("_cons"))
    j = ballots.join(cons, ["job_id", "candidate"], "left")
    rejected = ~F.col("promising")
    agg = j.groupBy("job_id", "rater").agg(
        F.count_if(rejected).alias("rejected"),
        F.count_if(rejected & F.coalesce(F.col("_cons"), F.lit(False))).alias("_rej_in_cons"))
    return agg.select("job_id", "rater", F.col("rejected").cast("bigint").alias("rejected"),
                      F.when(F.col("rejected") == 0, F.lit(0.0))
                      .otherwise((F.col("rejected") - F.col("_rej_in_cons")) / F.col("rejected"))
                      .alias("filter_accuracy"))


#: Output column -> the error column and whether a higher value is better.
BETTER = {"model_ranking_better_or_equal": ("tau", True), "model_categorization_better_or_equal": ("hamming", False)}


def better_or_equal(model_err: DataFrame, human_err: DataFrame, measures: dict[str, tuple[str, bool]] = BETTER) -> DataFrame:
    """A11 + J6 + E4: share of raters the model ties or beats, for each measure in its direction."""
    m = model_err.select("job_id", *[F.col(c).alias(f"_m_{c}") for c in dict.fromkeys(c for c, _ in measures.values())])

    def share(column: str, higher: bool) -> Column:
        mine, theirs = F.col(f"_m_{column}"), F.col(column)
        return F.avg(F.when(mine >= theirs if higher else mine <= theirs, 1.0).otherwise(0.0))

    return human_err.join(m, "job_id").groupBy("job_id").agg(*[share(*v).alias(k) for k, v in measures.items()])


def job_metrics(ballots: DataFrame, headers: DataFrame, model: DataFrame, run_info: DataFrame,
                method: str = "rank", materialize: bool = True) -> DataFrame:
    """One row per job with all reported metrics.

    The consensus feeds five branches; with ``materialize`` it is written
    once to the checkpoint folder (reliable checkpoint, small table).
    """
    consensus = consensus_ballots(ballots)
    if materialize:
        consensus = checkpointed(consensus)
    # J4 + J5 in one pass: the model is one more ballot against the consensus
    everyone = ballots.select(*BALLOT_COLS).unionByName(model_as_ballot(model))
    errs = compare_to_reference(everyone, consensus, method)
    if materialize:
        errs = checkpointed(errs)
    human_err = errs.filter(F.col("rater") != MODEL_ENTITY)                          # J4
    model_err = errs.filter(F.col("rater") == MODEL_ENTITY)                          # J5
    mean_err = human_err.groupBy("job_id").agg(F.avg("hamming").alias("human_hamming"),
                                               F.avg("tau").alias("human_tau"))   # A10
    mh = model_err.select("job_id", F.col("hamming").cast("double").alias("model_hamming"),
                          F.col("tau").alias("model_tau"))
    boe = better_or_equal(model_err, human_err)
    minutes = consensus_header(headers)
    time_sav = (minutes.join(run_info, "job_id")                                       # A15
                .select("job_id", ((F.col("mean_minutes") * 60 - F.col("seconds_taken"))
                                   / (F.col("mean_minutes") * 60)).alias("time_savings")))
    mfa = filter_accuracy(model_as_ballot(model), consensus).select(
        "job_id", F.col("rejected").cast("double").alias("candidates_filtered_by_model"),
        F.col("filter_accuracy").alias("model_filter_accuracy"))
    hfa = (filter_accuracy(ballots, consensus).groupBy("job_id")                     # A14
           .agg(F.avg("rejected").alias("candidates_filtered_by_humans"),
                F.avg("filter_accuracy").alias("human_filter_accuracy")))
    jobs = consensus.select("job_id").distinct()
    out = jobs
    for part in (mean_err, mh, boe, time_sav, mfa, hfa):
        out = out.join(part, "job_id", "left")
    return out.select("job_id", *JOB_METRIC_COLUMNS)


def missing_model_jobs(consensus: DataFrame, model: DataFrame) -> DataFrame:
    """J5 error path: jobs with a consensus but no model result."""
    return consensus.select("job_id").distinct().join(model.select("job_id").distinct(), "job_id", "left_anti")


def overall_metrics(per_job: DataFrame) -> DataFrame:
    """Unweighted mean over jobs of every metric column."""
    return per_job.agg(*[F.avg(c).alias(c) for c in JOB_METRIC_COLUMNS])
