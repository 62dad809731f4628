"""Queries for the described-only operators D1-D6 (optional)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwise.functions.columns import round6
from rankwise.operators import consensus, described, scoring
from rankwise.plans import fixtures as fx
from rankwise.plans.oracle import CONSENSUS_SQL, F1_SQL, F2_SQL, TYPES_VALUES_SQL
from rankwise.plans.q_front import NATIVE_SQL, _TOKS, _front, _front_scores
from rankwise.plans.registry import register
from rankwise.schemas import REQUIREMENT_TYPES
from rankwise.sources.tables import table

P_RBO = 0.9


@register("rank_biased_overlap", f"""WITH {F2_SQL},{CONSENSUS_SQL},
k AS (SELECT job_id, max(place) AS k FROM ballots GROUP BY ALL),
dd AS (SELECT job_id, unnest(range(1, k + 1)) AS d FROM k),
ov AS (
  SELECT b.job_id, b.rater, dd.d, count(*) FILTER (WHERE b.place <= dd.d AND c.place <= dd.d) AS o
  FROM ballots b JOIN consensus c USING (job_id, candidate) JOIN dd ON dd.job_id = b.job_id GROUP BY ALL
)
SELECT job_id, rater, round((1 - {P_RBO}) * sum(pow({P_RBO}, d - 1) * o / d), 6) AS rbo FROM ov GROUP BY ALL""")
def q_rank_biased_overlap(spark, sf_dir):
    b, _ = fx.f2_ballots(spark, sf_dir)
    r = described.rank_biased_overlap(b, consensus.consensus_ballots(b), P_RBO)
    return r.select("job_id", "rater", round6("rbo").alias("rbo"))


@register("keyword_distance", f"""WITH {NATIVE_SQL},
dw AS (SELECT DISTINCT job_id, candidate_id, unnest({_TOKS.format(x='text')}) AS w FROM ndocs),
kw AS (SELECT DISTINCT job_id, unnest({_TOKS.format(x='specification')}) AS w FROM reqs),
dcount AS (SELECT job_id, candidate_id, count(*) AS nd FROM dw GROUP BY ALL),
kn AS (SELECT job_id, count(*) AS nk FROM kw GROUP BY ALL),
bn AS (SELECT dw.job_id, dw.candidate_id, count(*) AS nb FROM dw JOIN kw USING (job_id, w) GROUP BY ALL)
SELECT d.job_id, d.candidate_id,
       round(sqrt(coalesce(dcount.nd, 0) + coalesce(kn.nk, 0) - 2 * coalesce(bn.nb, 0)), 6) AS distance
FROM docs d LEFT JOIN dcount USING (job_id, candidate_id) LEFT JOIN kn USING (job_id)
LEFT JOIN bn USING (job_id, candidate_id)""")
def q_keyword_distance(spark, sf_dir):
    reqs, docs = _front(spark, sf_dir)
    d = described.keyword_distance(docs, reqs)
    return d.select("job_id", "candidate_id", round6("distance").alias("distance"))


def _cost_sql() -> str:
    from rankwise.plans.registry import REGISTRY
    inner = REGISTRY["match_requests"][1]
    return f"""SELECT job_id, CAST(count(*) AS BIGINT) AS n_requests, CAST(sum(ceil(prompt_chars / 4)) AS BIGINT) AS input_tokens,
       round(sum(ceil(prompt_chars / 4)) * 10.0 / 1e6, 6) AS cost,
       CAST(count(*) FILTER (WHERE ceil(prompt_chars / 4) > 128000) AS BIGINT) AS over_context
FROM ({inner}) mr GROUP BY ALL"""


@register("request_cost_estimate", _cost_sql())
def q_request_cost_estimate(spark, sf_dir):
    """D3: tokens (chars / 4) and cost (10 $ per million input tokens) of the
    match requests per job, and requests over a 128k-token context."""
    from rankwise.plans.q_front import q_match_requests
    req = q_match_requests(spark, sf_dir)
    c = described.cost_estimate(req, "prompt_chars", 10.0, 128_000)
    return c.select("job_id", F.col("n_requests").cast("bigint").alias("n_requests"),
                    F.col("input_tokens").cast("bigint").alias("input_tokens"), round6("cost").alias("cost"),
                    F.col("over_context").cast("bigint").alias("over_context"))


@register("shortlist", f"""WITH {NATIVE_SQL},
m AS (SELECT job_id, candidate_id, sum(least(100, greatest(0, score))) / count(*) AS mean_score FROM native GROUP BY ALL)
SELECT job_id, candidate_id, CAST(rk AS BIGINT) AS rank, round(mean_score, 6) AS mean_score FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY mean_score DESC, candidate_id) AS rk FROM m)
WHERE rk <= 5""")
def q_shortlist(spark, sf_dir):
    """Top five per job by the cheap n-gram score (a top-k report)."""
    _, _, scores = _front_scores(spark, sf_dir)
    s = described.shortlist(scores, 5)
    return s.select("job_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"),
                    round6("mean_score").alias("mean_score"))


@register("shortlist_coarse_to_fine", f"""WITH {NATIVE_SQL},
rt AS (SELECT job_id, requirement_id, list_distinct({_TOKS.format(x='specification')}) AS t FROM reqs),
wt AS (SELECT job_id, token, sum(w) AS w FROM (SELECT job_id, CAST(floor(1000000 / greatest(len(t), 1)) AS BIGINT) AS w, unnest(t) AS token FROM rt) GROUP BY ALL),
dt AS (SELECT job_id, candidate_id, unnest(list_distinct({_TOKS.format(x='text')})) AS token FROM ndocs),
co AS (SELECT job_id, candidate_id, sum(w) AS c FROM dt JOIN wt USING (job_id, token) GROUP BY ALL),
kept AS (SELECT job_id, candidate_id FROM (SELECT d.job_id, d.candidate_id, row_number() OVER (PARTITION BY d.job_id ORDER BY coalesce(c, 0) DESC, d.candidate_id) AS r
         FROM docs d LEFT JOIN co USING (job_id, candidate_id)) WHERE r <= 15),
m AS (SELECT job_id, candidate_id, sum(score) / count(*) AS mean_score FROM native JOIN kept USING (job_id, candidate_id) GROUP BY ALL)
SELECT job_id, candidate_id, CAST(rk AS BIGINT) AS rank, round(mean_score, 6) AS mean_score FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY mean_score DESC, candidate_id) AS rk FROM m)
WHERE rk <= 5""")
def q_shortlist_coarse_to_fine(spark, sf_dir):
    """Top five per job (a top-k report) out of the fifteen best by shared words; only these are scored in full."""
    s = described.shortlist_coarse_to_fine(*_front(spark, sf_dir), 5, 15)
    return s.select("job_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"), round6("mean_score").alias("mean_score"))


# Fixed presets (configuration): per job group a weighting of the types.
PRESETS = {"default": dict(REQUIREMENT_TYPES),
           "skills_first": {t: (30 if t in ("hard_skills", "soft_skills") else 5) for t, _ in REQUIREMENT_TYPES},
           "experience_first": {t: (40 if t == "work_experience" else 6) for t, _ in REQUIREMENT_TYPES}}
JOB_PRESET = {"A": "default", "N": "skills_first", "R": "experience_first"}


def _preset_values() -> str:
    return ", ".join(f"('{p}', '{t}', {w})" for p, ws in PRESETS.items() for t, w in ws.items())


@register("preset_weighted_totals", f"""WITH {F1_SQL},
presets(preset, type, weighting) AS (VALUES {_preset_values()}),
jp(job_id, preset) AS (VALUES {", ".join(f"('{j}', '{p}')" for j, p in JOB_PRESET.items())})
SELECT c.job_id, c.candidate_id,
       round(0.0 + sum(CAST(c.s AS DOUBLE) / c.n * pr.weighting) / sum(CAST(pr.weighting AS DOUBLE)), 6) AS total_score
FROM cat c JOIN jp USING (job_id) JOIN presets pr ON pr.preset = jp.preset AND pr.type = c.type GROUP BY ALL""")
def q_preset_weighted_totals(spark, sf_dir):
    """Weights per job group - the preset dimension is joined through the job."""
    scores = scoring.clamp_scores(fx.f1_requirement_scores(spark, sf_dir))
    presets = spark.createDataFrame([(p, t, w) for p, ws in PRESETS.items() for t, w in ws.items()],
                                    "preset string, type string, weighting int")
    jp = spark.createDataFrame(list(JOB_PRESET.items()), "job_id string, preset string")
    stats = scoring.category_stats(scores).join(F.broadcast(jp), "job_id")
    w = stats.join(F.broadcast(presets), ["preset", "type"])
    t = w.groupBy("job_id", "candidate_id").agg(
        (F.sum(F.col("sum_above_min") / F.col("n_scores") * F.col("weighting")) / F.sum("weighting")).alias("t"))
    return t.select("job_id", "candidate_id", round6(F.lit(0.0) + F.col("t")).alias("total_score"))


@register("knocked_out", f"""WITH {F1_SQL}
SELECT job_id, candidate_id, round(min(m), 6) AS lowest_mandatory FROM (
  SELECT job_id, candidate_id, type, sum(score) / count(*) AS m FROM scores WHERE kind = 'mandatory' GROUP BY ALL)
GROUP BY ALL HAVING min(m) < 35""")
def q_knocked_out(spark, sf_dir):
    """Knock-out on a mandatory requirement type mean below 35."""
    scores = scoring.clamp_scores(fx.f1_requirement_scores(spark, sf_dir))
    k = described.knocked_out(scores, 35)
    return k.select("job_id", "candidate_id", round6("lowest_mandatory").alias("lowest_mandatory"))


@register("faded_scores", """
WITH li AS (SELECT l_returnflag AS job_id, l_suppkey AS candidate_id, least(100, greatest(0, floor(l_quantity * 2.5 - 10))) AS score,
                   (epoch(max(l_shipdate) OVER ()) - epoch(l_shipdate)) / (365.25 * 86400) AS years FROM lineitem)
SELECT job_id, candidate_id, round(sum(score * exp(-years / 3.0)) / sum(exp(-years / 3.0)), 6) AS faded_score
FROM li GROUP BY ALL""")
def q_faded_scores(spark, sf_dir):
    """Fading of old experience - each score weighted by exp(-age / 3 years),
    age measured from the newest ship date."""
    li = table(spark, sf_dir, "lineitem")
    newest = li.agg(F.max("l_shipdate").alias("m")).first()["m"]
    years = (F.unix_micros(F.lit(newest).cast("timestamp")) - F.unix_micros(F.col("l_shipdate").cast("timestamp"))) \
        / F.lit(365.25 * 86400 * 1e6)
    s = li.select(F.col("l_returnflag").alias("job_id"), F.col("l_suppkey").alias("candidate_id"),
                  F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("l_quantity") * 2.5 - 10))).alias("score"),
                  described.fading_weight(years, 3.0).alias("w"))
    return (s.groupBy("job_id", "candidate_id").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("f"))
            .select("job_id", "candidate_id", round6("f").alias("faded_score")))
