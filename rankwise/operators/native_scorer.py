"""Native requirement scorer (X22) and the J1 fan-out.

The reference asks a remote model to score each (requirement, CV) pair.
The default scorer here is deterministic and relational: the score is the
share of the requirement's distinct 1-3-grams that occur in the document,
scaled to 0-100, with an explanation naming the counts.  It is an honest
simple replacement, not a claim of equal judgement quality.

Plan: the distinct n-grams of a document are built inside its row and met with
the requirement n-grams **of the same job** at once, so that no task holds or
sorts more than a document's n-grams; what is shuffled is one count per
``(job, requirement, candidate)`` and task, as far as the requirements can be
broadcast.  Rows of one ``(job, candidate)`` are one document whose tokens stand
side by side by position: the few that repeat a key go through a window over
the tokens that occur in requirements.  No document text travels with the
pairs; pairs without a hit keep score 0 through a left join from the fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwise.functions.text import ngrams, tokens
from rankwise.schemas import MAX_SCORE, MIN_SCORE


def fan_out(requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every requirement of a job against every candidate of that job
    (equi join on ``job_id``; ids only, texts attached later if needed)."""
    return (requirements.select("job_id", "requirement_id").join(candidates.select("job_id", "candidate_id"), "job_id"))


def requirement_ngrams(requirements: DataFrame, text_col: str = "specification", max_n: int = 3) -> DataFrame:
    toks = requirements.select("job_id", "requirement_id", tokens(text_col).alias("_t"))
    return toks.select("job_id", "requirement_id", F.explode(F.array_distinct(ngrams(F.col("_t"), max_n))).alias("ngram"))


def row_ngrams(candidates: DataFrame, text_col: str = "text", max_n: int = 3) -> DataFrame:
    """Distinct 1..max_n-grams of each row's text."""
    toks = candidates.select("job_id", "candidate_id", tokens(text_col).alias("_t"))
    return toks.select("job_id", "candidate_id", F.explode(F.array_distinct(ngrams(F.col("_t"), max_n))).alias("ngram"))


def document_ngrams(candidates: DataFrame, vocabulary: DataFrame, text_col: str = "text", max_n: int = 3) -> DataFrame:
    """Distinct 1..max_n-grams of each document, be it several rows, whose tokens are all in ``vocabulary`` ``(job_id, token)``."""
    toks = (candidates.select("job_id", "candidate_id", F.posexplode(tokens(text_col)).alias("pos", "token"))
            .join(vocabulary, ["job_id", "token"], "left_semi"))
    line = Window.partitionBy("job_id", "candidate_id").orderBy("pos")  # the survivors of one document
    grams, gram, unbroken = [F.col("token")], F.col("token"), F.lit(True)
    for k in range(1, max_n):
        toks = toks.withColumn(f"_t{k}", F.lead("token", k).over(line)).withColumn(f"_p{k}", F.lead("pos", k).over(line))
        unbroken = unbroken & (F.col(f"_p{k}") == F.col("pos") + k)
        gram = F.concat(gram, F.lit(" "), F.col(f"_t{k}"))
        grams.append(F.when(unbroken, gram))
    found = toks.select("job_id", "candidate_id", F.explode(F.array(*grams)).alias("ngram"))
    return found.filter(F.col("ngram").isNotNull()).distinct()


def overlap_scores(requirements: DataFrame, candidates: DataFrame, max_n: int = 3,
                   lo: int = MIN_SCORE, hi: int = MAX_SCORE) -> DataFrame:
    """``(job_id, requirement_id, candidate_id, hits, total, score, explanation)``."""
    rq = requirement_ngrams(requirements, max_n=max_n)
    totals = rq.groupBy("job_id", "requirement_id").agg(F.count(F.lit(1)).alias("total"))
    vocab = requirements.select("job_id", F.explode(tokens("specification")).alias("token")).distinct()
    repeated = F.broadcast(candidates.groupBy("job_id", "candidate_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    keys = ["job_id", "candidate_id"]
    dn = row_ngrams(candidates.join(repeated, keys, "left_anti"), max_n=max_n)
    merged = document_ngrams(candidates.join(repeated, keys, "left_semi"), vocab, max_n=max_n)
    hits = (dn.join(rq, ["job_id", "ngram"]).unionByName(merged.join(rq, ["job_id", "ngram"]))
            .groupBy("job_id", "requirement_id", "candidate_id").agg(F.count(F.lit(1)).alias("hits")))
    pairs = fan_out(requirements, candidates)
    out = (pairs.join(totals, ["job_id", "requirement_id"], "left")
           .join(hits, ["job_id", "requirement_id", "candidate_id"], "left")
           .withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint"))
           .withColumn("total", F.coalesce("total", F.lit(0)).cast("bigint")))
    score = F.when(F.col("total") > 0,
                   F.floor(F.lit(lo) + (hi - lo) * F.col("hits") / F.col("total") + F.lit(0.5))).otherwise(F.lit(lo))
    return (out.withColumn("score", score.cast("int"))
            .withColumn("explanation", F.format_string("%d of %d requirement n-grams found in the document",
                                                       F.col("hits"), F.col("total"))))


def native_answers(requirements: DataFrame, candidates: DataFrame, max_n: int = 3) -> DataFrame:
    """The scorer as answer text, shaped like a model reply (goes through X15/P3)."""
    s = overlap_scores(requirements, candidates, max_n)
    return s.select("job_id", "requirement_id", "candidate_id",
                    F.to_json(F.struct(F.col("score").alias("value"), "explanation")).alias("answer"))
