"""Ballots: wide form -> long form, invariants, top-k prefix.

Long ballot rows: ``(job_id, rater, rater_ord, candidate, pos, place, promising)``
where ``pos`` is the candidate's slot in the ballot as entered (the
first-seen order of the reference) and ``place`` its rank (1 = best).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.operators.ranking import rank_within
from rankwise.functions.columns import ballot_timestamp, label_suffix, name_set

BLOCK = 10  # wide CSV: per job 1 minutes column, 1 promising list, 8 places


def csv_layout(columns: list[str], block: int = BLOCK, first: int = 1) -> list[dict]:
    """Positional layout of the wide ballot CSV: after ``first`` leading columns,
    per job one block ``[minutes, promising list, place of <name> ...]``.
    Repeated header texts get suffixes on read, so blocks are found by
    position, never by text.  Columns that do not fill a block are an error."""
    body = columns[first:]
    if len(body) % block:
        raise ValueError(f"{len(body)} columns do not make whole blocks of {block}")
    return [{"job_id": str(j + 1), "minutes": body[j * block], "promising": body[j * block + 1],
             "places": [(c, c) for c in body[j * block + 2:(j + 1) * block]]}
            for j in range(len(body) // block)]


def unpivot_wide(wide: DataFrame, layout: list[dict], rater_col: str = "rater_ord",
                 ts_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """P1 + X2 + X3 + X4: wide ballot rows -> (ballots, headers).

    ``layout`` lists per job the minutes column, the promising-list column
    and ``(place column, header label)`` pairs (see ``csv_layout``).  The
    candidate name is the label without its first two words.  The fan-out
    is a single projection (``inline`` of arrays of structs): no shuffle.
    A blank or unreadable place stays as a row with a null place, which
    makes its ballot invalid (``ballot_checks``).
    """
    per_slot, per_job = [], []
    for k, blk in enumerate(layout):
        listed = name_set(F.col(f"`{blk['promising']}`"))
        per_job.append(F.struct(F.lit(blk["job_id"]).alias("job_id"),
                                F.col(f"`{blk['minutes']}`").try_cast("double").alias("minutes"),
                                listed.alias("promising_set")))
        on_list = F.col("_jobs")[k]["promising_set"]
        for s, (c, label) in enumerate(blk["places"]):
            per_slot.append(F.struct(F.lit(blk["job_id"]).alias("job_id"), F.lit(s).alias("pos"),
                                     label_suffix(F.lit(label)).alias("candidate"),
                                     F.col(f"`{c}`").try_cast("int").alias("place"),
                                     F.coalesce(F.array_contains(on_list, label_suffix(F.lit(label))), F.lit(False))
                                     .alias("promising")))
    ts = ballot_timestamp(F.col(f"`{ts_col}`")) if ts_col else F.lit(None).cast("timestamp")
    base = wide.select("*", F.col(rater_col).cast("int").alias("_rater"), ts.alias("submitted"), F.array(*per_job).alias("_jobs"))
    base = base.select(F.col("_rater").alias("rater_ord"), "submitted", "_jobs", F.array(*per_slot).alias("_slots"))
    rater = F.concat(F.lit("human_id: "), F.col("rater_ord").cast("string"))
    headers = base.select("rater_ord", "submitted", F.inline("_jobs")).withColumn("rater", rater)
    ballots = base.select("rater_ord", F.inline("_slots")).withColumn("rater", rater)
    return (ballots.select("job_id", "rater", "rater_ord", "candidate", "pos", "place", "promising"),
            headers.select("job_id", "rater", "rater_ord", "submitted", "minutes", "promising_set"))


def rater_ids(raw: DataFrame, ts_col: str) -> DataFrame:
    """Rater id = row index in the file (0-based), taken from the time stamp
    order (the file is written in submission order; equal time stamps by the
    rest of the row)."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]))
    ranked = rank_within(raw, [], [ballot_timestamp(F.col(f"`{ts_col}`")), rest], name="rater_ord")
    return ranked.withColumn("rater_ord", (F.col("rater_ord") - 1).cast("int"))


def ballot_checks(ballots: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """P4 + U4: one row per ballot with the four invariants and ``valid``.

    * places are exactly 1..n, all distinct; a missing place (null) breaks it
    * candidates distinct
    * promising set is a subset of the ballot's candidates (needs ``headers``
      with ``promising_set``; long-form ballots satisfy it by construction)
    * promising set is exactly the top-k prefix of the ranking
    """
    per = (ballots.groupBy("job_id", "rater")
           .agg(F.count(F.lit(1)).alias("n"),
                F.count_distinct("place").alias("n_places"),
                F.count_distinct("candidate").alias("n_candidates"),
                F.min("place").alias("min_place"), F.max("place").alias("max_place"),
                F.count_if("promising").alias("k"),
                F.coalesce(F.max(F.when(F.col("promising"), F.col("place"))), F.lit(0)).alias("max_promising_place")))
    if headers is not None and "promising_set" in headers.columns:
        # names in the promising list that are not on the ballot (anti join, no collect)
        listed = headers.select("job_id", "rater", F.explode("promising_set").alias("candidate"))
        stray = (listed.join(ballots.select("job_id", "rater", "candidate"), ["job_id", "rater", "candidate"],
                             "left_anti")
                 .groupBy("job_id", "rater").agg(F.count(F.lit(1)).alias("_stray")))
        per = per.join(stray, ["job_id", "rater"], "left")
        subset = F.coalesce(F.col("_stray") == 0, F.lit(True))
    else:
        subset = F.lit(True)
    out = per.select(
        "job_id", "rater", F.col("n").cast("bigint").alias("n"), F.col("k").cast("bigint").alias("k"),
        F.coalesce((F.col("n_places") == F.col("n")) & (F.col("min_place") == 1) & (F.col("max_place") == F.col("n")),
                   F.lit(False)).alias("places_complete"),
        (F.col("n_candidates") == F.col("n")).alias("candidates_distinct"),
        subset.alias("promising_subset"),
        (F.col("max_promising_place") == F.col("k")).alias("promising_is_prefix"))
    return out.withColumn("valid", F.col("places_complete") & F.col("candidates_distinct")
                          & F.col("promising_subset") & F.col("promising_is_prefix"))


def top_k_prefix(ballots: DataFrame) -> DataFrame:
    """O3: the k best places of each ballot, k = size of its promising set."""
    k = ballots.groupBy("job_id", "rater").agg(F.count_if("promising").alias("_k"))
    return ballots.join(k, ["job_id", "rater"]).filter(F.col("place") <= F.col("_k")).drop("_k")


def promising_only(ballots: DataFrame) -> DataFrame:
    """P10: rows whose flag is true."""
    return ballots.filter(F.col("promising"))
