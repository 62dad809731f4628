"""Evaluation queries on adapters F2 (human ballots) and F3 (model ballots):
ballots, consensus, agreement, metrics, matrices and time tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwise.functions.columns import round6
from rankwise.operators import agreement, ballots as bl, consensus, matrices, metrics
from rankwise.plans import fixtures as fx
from rankwise.plans.oracle import CONSENSUS_SQL, F2_PART_SQL, F2_SQL, compare_sql, pairwise_sql
from rankwise.plans.registry import register

W = f"WITH {F2_SQL},{CONSENSUS_SQL}"


def _ballots(spark, sf_dir):
    return fx.f2_ballots(spark, sf_dir)


def _entities(spark, sf_dir):
    """Human ballots plus the model as one more entity."""
    vol = fx.brand_volume(spark, sf_dir)
    b, _ = fx.f2_ballots(spark, sf_dir, vol)
    m, _ = fx.f3_model_ballots(spark, sf_dir, vol)
    return b.select(*agreement.BALLOT_COLS).unionByName(metrics.model_as_ballot(m))


def _round_cols(df, cols):
    return df.select(*[round6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ ballots

@register("wide_ballots_unpivot", f"""{W}
SELECT h.job_id, h.rater, CAST(h.rater_ord AS BIGINT) AS rater_ord, c.candidate, CAST(b.place AS BIGINT) AS place,
       coalesce(b.promising, false) AS promising, h.minutes
FROM headers h JOIN (SELECT DISTINCT job_id, candidate FROM ballots) c USING (job_id)
LEFT JOIN ballots b ON b.job_id = h.job_id AND b.rater = h.rater AND b.candidate = c.candidate""")
def q_wide_ballots_unpivot(spark, sf_dir):
    wide, layout = fx.f2_wide(spark, sf_dir)
    b, h = bl.unpivot_wide(wide, layout)
    return (b.join(h.select("job_id", "rater", "minutes"), ["job_id", "rater"])
            .select("job_id", "rater", F.col("rater_ord").cast("bigint").alias("rater_ord"), "candidate",
                    F.col("place").cast("bigint").alias("place"), "promising", "minutes"))


@register("ballot_checks", f"""{W}
SELECT job_id, rater, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE promising) AS BIGINT) AS k,
       count(DISTINCT place) = count(*) AND min(place) = 1 AND max(place) = count(*) AS places_complete,
       count(DISTINCT candidate) = count(*) AS candidates_distinct, true AS promising_subset,
       coalesce(max(place) FILTER (WHERE promising), 0) = count(*) FILTER (WHERE promising) AS promising_is_prefix,
       count(DISTINCT place) = count(*) AND min(place) = 1 AND max(place) = count(*)
         AND count(DISTINCT candidate) = count(*)
         AND coalesce(max(place) FILTER (WHERE promising), 0) = count(*) FILTER (WHERE promising) AS valid
FROM ballots GROUP BY ALL""")
def q_ballot_checks(spark, sf_dir):
    b, _ = _ballots(spark, sf_dir)
    return bl.ballot_checks(b)


@register("broken_ballot_checks", f"""{W}, broken AS (
  SELECT job_id, rater, rater_ord % 6 AS c,
         CASE WHEN rater_ord % 6 = 0 AND place = 2 THEN NULL WHEN rater_ord % 6 = 1 AND place = 2 THEN 1 ELSE place END AS place,
         CASE WHEN rater_ord % 6 = 4 AND place = 2 THEN first_value(candidate) OVER (PARTITION BY job_id, rater ORDER BY place)
              ELSE candidate END AS candidate,
         promising AND NOT (rater_ord % 6 = 3 AND place = 1) AS promising
  FROM ballots
)
SELECT job_id, rater, c NOT IN (0, 1) AS places_complete, c <> 4 AS candidates_distinct, c <> 2 AS promising_subset,
       max(place) FILTER (WHERE promising) = count(*) FILTER (WHERE promising) AS promising_is_prefix,
       c = 5 AS valid
FROM broken GROUP BY ALL""")
def q_broken_ballot_checks(spark, sf_dir):
    """P4 + U4 on ballots with one defect each, by rater: a missing place, a place given twice, a name that is not
    on the ballot, a list that is no prefix, a candidate named twice, none."""
    b, _ = _ballots(spark, sf_dir)
    kind = F.col("rater_ord") % 6
    best = b.filter("place = 1").select("job_id", "rater", F.col("candidate").alias("_best"))
    broken = (b.join(best, ["job_id", "rater"], "left")
              .withColumn("candidate", F.when((kind == 4) & (F.col("place") == 2), F.col("_best")).otherwise(F.col("candidate")))
              .withColumn("promising", F.col("promising") & ~((kind == 3) & (F.col("place") == 1)))
              .withColumn("place", F.when((kind == 0) & (F.col("place") == 2), F.lit(None))
                          .when((kind == 1) & (F.col("place") == 2), F.lit(1)).otherwise(F.col("place"))))
    listed = broken.groupBy("job_id", "rater", "rater_ord").agg(
        F.collect_set(F.when(F.col("promising"), F.col("candidate"))).alias("s"))
    headers = listed.select("job_id", "rater", F.when(kind == 2, F.array_append("s", F.lit("nobody"))).otherwise(F.col("s"))
                            .alias("promising_set"))
    return bl.ballot_checks(broken, headers).drop("n", "k")


@register("top_k_prefix", f"""{W}
SELECT job_id, rater, candidate, CAST(place AS BIGINT) AS place FROM ballots b
WHERE place <= (SELECT count(*) FROM ballots c WHERE c.job_id = b.job_id AND c.rater = b.rater AND c.promising)""")
def q_top_k_prefix(spark, sf_dir):
    b, _ = _ballots(spark, sf_dir)
    return bl.top_k_prefix(b).select("job_id", "rater", "candidate", F.col("place").cast("bigint").alias("place"))


@register("promising_rows", f"""{W}
SELECT job_id, rater, candidate, CAST(place AS BIGINT) AS place FROM ballots WHERE promising""")
def q_promising_rows(spark, sf_dir):
    b, _ = _ballots(spark, sf_dir)
    return bl.promising_only(b).select("job_id", "rater", "candidate", F.col("place").cast("bigint").alias("place"))


# ---------------------------------------------------------------- consensus

@register("majority_set", f"""{W}
SELECT job_id, candidate, votes, n_ballots, in_majority FROM maj""")
def q_majority_set(spark, sf_dir):
    b, _ = _ballots(spark, sf_dir)
    return consensus.majority_set(b).select("job_id", "candidate", F.col("votes").cast("bigint").alias("votes"),
                                            F.col("n_ballots").cast("bigint").alias("n_ballots"), "in_majority")


@register("consensus_ranking", f"""{W}
SELECT job_id, candidate, CAST(place AS BIGINT) AS place, round(mean_place, 6) AS mean_place,
       CAST(mode_place AS BIGINT) AS mode_place, CAST(min_place AS BIGINT) AS min_place,
       CAST(max_place AS BIGINT) AS max_place
FROM cons_rank""")
def q_consensus_ranking(spark, sf_dir):
    b, _ = _ballots(spark, sf_dir)
    r = consensus.consensus_ranking(b)
    return r.select("job_id", "candidate", F.col("place").cast("bigint").alias("place"),
                    round6("mean_place").alias("mean_place"),
                    *[F.col(c).cast("bigint").alias(c) for c in ("mode_place", "min_place", "max_place")])


@register("consensus_minutes", f"""{W}
SELECT job_id, round(sum(minutes) / count(minutes), 6) AS mean_minutes FROM headers GROUP BY ALL""")
def q_consensus_minutes(spark, sf_dir):
    _, h = _ballots(spark, sf_dir)
    return consensus.consensus_header(h).select("job_id", round6("mean_minutes").alias("mean_minutes"))


# ---------------------------------------------------------------- agreement

def _cmp_query(name, method, model=False):
    x = "model_b" if model else "ballots"
    sql = f"""{W},{compare_sql('cmp', x, 'consensus', method)}
SELECT job_id, {"" if model else "rater, "}hamming, round(tau, 6) AS tau, n FROM cmp"""

    @register(name, sql)
    def q(spark, sf_dir):
        b, _ = _ballots(spark, sf_dir)
        cons = consensus.consensus_ballots(b)
        if model:
            m, _ = fx.f3_model_ballots(spark, sf_dir)
            x_df = metrics.model_as_ballot(m)
        else:
            x_df = b
        out = agreement.compare_to_reference(x_df, cons, method)
        cols = ([] if model else ["rater"])
        return out.select("job_id", *cols, "hamming", round6("tau").alias("tau"), F.col("n").cast("bigint").alias("n"))
    return q


_cmp_query("rater_vs_consensus", "rank")
_cmp_query("rater_vs_consensus_label_sequence", "label_sequence")
_cmp_query("model_vs_consensus", "rank", model=True)
_cmp_query("model_vs_consensus_label_sequence", "label_sequence", model=True)


_PARTS = f"WITH {F2_PART_SQL},{CONSENSUS_SQL}"


@register("part_consensus_ranking", f"""{_PARTS}
SELECT job_id, candidate, CAST(place AS BIGINT) AS place, round(mean_place, 6) AS mean_place FROM cons_rank""")
def q_part_consensus_ranking(spark, sf_dir):
    """A5 on ballots of thousands of candidates, three hot jobs."""
    r = consensus.consensus_ranking(fx.f2_part_ballots(spark, sf_dir))
    return r.select("job_id", "candidate", "place", round6("mean_place").alias("mean_place"))


@register("part_rater_vs_consensus", f"""{_PARTS},{compare_sql('cmp', 'ballots', 'consensus', 'rank')}
SELECT job_id, rater, hamming, round(tau, 6) + 0.0 AS tau, CAST(n AS BIGINT) AS n FROM cmp""")
def q_part_rater_vs_consensus(spark, sf_dir):
    """J4 + A8 + A9 on them: discordant pairs without candidate pairs, across blocks."""
    b = fx.f2_part_ballots(spark, sf_dir)
    out = agreement.compare_to_reference(b, consensus.consensus_ballots(b), "rank")
    return out.select("job_id", "rater", "hamming", round6("tau").alias("tau"), F.col("n").cast("bigint").alias("n"))


@register("mean_rater_error", f"""{W},{compare_sql('cmp', 'ballots', 'consensus', 'rank')}
SELECT job_id, round(avg(hamming), 6) AS human_hamming, round(avg(tau), 6) + 0.0 AS human_tau FROM cmp GROUP BY ALL""")
def q_mean_rater_error(spark, sf_dir):
    b, _ = _ballots(spark, sf_dir)
    e = agreement.compare_to_reference(b, consensus.consensus_ballots(b), "rank")
    return (e.groupBy("job_id").agg(F.avg("hamming").alias("human_hamming"), F.avg("tau").alias("human_tau"))
            .select("job_id", round6("human_hamming").alias("human_hamming"), round6("human_tau").alias("human_tau")))


def _pairwise_query(name, method):
    sql = f"""{W}, ents AS (SELECT job_id, rater, rater_ord, candidate, place, promising FROM ballots
                   UNION ALL SELECT * FROM model_b),{pairwise_sql('pw', 'ents', method)}
SELECT job_id, entity_a, entity_b, hamming, round(tau, 6) AS tau, n FROM pw"""

    @register(name, sql)
    def q(spark, sf_dir):
        p = agreement.pairwise(_entities(spark, sf_dir), method)
        return p.select("job_id", "entity_a", "entity_b", "hamming", round6("tau").alias("tau"),
                        F.col("n").cast("bigint").alias("n"))
    return q


_pairwise_query("pairwise_agreement", "rank")
_pairwise_query("pairwise_agreement_label_sequence", "label_sequence")


# ------------------------------------------------------------------ metrics

def _metrics_sql(method: str) -> str:
    return f"""{W},{compare_sql('herr', 'ballots', 'consensus', method)},{compare_sql('merr', 'model_b', 'consensus', method)},
fa AS (
  SELECT x.job_id, x.rater, count(*) FILTER (WHERE NOT x.promising) AS rej,
         count(*) FILTER (WHERE NOT x.promising AND coalesce(c.promising, false)) AS rej_in
  FROM (SELECT job_id, rater, candidate, promising FROM ballots UNION ALL
        SELECT job_id, rater, candidate, promising FROM model_b) x
  LEFT JOIN consensus c USING (job_id, candidate) GROUP BY ALL
),
fa2 AS (SELECT job_id, rater, CAST(rej AS DOUBLE) AS rej,
               CASE WHEN rej = 0 THEN 0.0 ELSE CAST(rej - rej_in AS DOUBLE) / rej END AS acc FROM fa),
per_job AS (
  SELECT c.job_id,
    (SELECT avg(hamming) FROM herr h WHERE h.job_id = c.job_id) AS human_hamming,
    (SELECT avg(tau) FROM herr h WHERE h.job_id = c.job_id) AS human_tau,
    (SELECT CAST(hamming AS DOUBLE) FROM merr m WHERE m.job_id = c.job_id) AS model_hamming,
    (SELECT tau FROM merr m WHERE m.job_id = c.job_id) AS model_tau,
    (SELECT avg(CASE WHEN m.tau >= h.tau THEN 1.0 ELSE 0.0 END) FROM herr h JOIN merr m USING (job_id)
      WHERE h.job_id = c.job_id) AS model_ranking_better_or_equal,
    (SELECT avg(CASE WHEN m.hamming <= h.hamming THEN 1.0 ELSE 0.0 END) FROM herr h JOIN merr m USING (job_id)
      WHERE h.job_id = c.job_id) AS model_categorization_better_or_equal,
    (SELECT (sum(minutes) / count(minutes) * 60 - any_value(r.seconds_taken)) / (sum(minutes) / count(minutes) * 60)
       FROM headers hd JOIN run_info r USING (job_id) WHERE hd.job_id = c.job_id) AS time_savings,
    (SELECT rej FROM fa2 WHERE fa2.job_id = c.job_id AND fa2.rater = 'model') AS candidates_filtered_by_model,
    (SELECT acc FROM fa2 WHERE fa2.job_id = c.job_id AND fa2.rater = 'model') AS model_filter_accuracy,
    (SELECT avg(rej) FROM fa2 WHERE fa2.job_id = c.job_id AND fa2.rater <> 'model') AS candidates_filtered_by_humans,
    (SELECT avg(acc) FROM fa2 WHERE fa2.job_id = c.job_id AND fa2.rater <> 'model') AS human_filter_accuracy
  FROM (SELECT DISTINCT job_id FROM consensus) c
)"""


_METRIC_COLS = metrics.JOB_METRIC_COLUMNS


def _metrics_query(name, method):
    sql = f"""{_metrics_sql(method)}
SELECT job_id, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _METRIC_COLS)} FROM per_job"""

    @register(name, sql)
    def q(spark, sf_dir):
        vol = fx.brand_volume(spark, sf_dir)
        b, h = fx.f2_ballots(spark, sf_dir, vol)
        m, info = fx.f3_model_ballots(spark, sf_dir, vol)
        return _round_cols(metrics.job_metrics(b, h, m, info, method), set(_METRIC_COLS))
    return q


_metrics_query("job_metrics", "rank")
_metrics_query("job_metrics_label_sequence", "label_sequence")


@register("overall_metrics", f"""{_metrics_sql('label_sequence')}
SELECT {", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in _METRIC_COLS)} FROM per_job""")
def q_overall_metrics(spark, sf_dir):
    vol = fx.brand_volume(spark, sf_dir)
    b, h = fx.f2_ballots(spark, sf_dir, vol)
    m, info = fx.f3_model_ballots(spark, sf_dir, vol)
    per_job = metrics.job_metrics(b, h, m, info, "label_sequence")
    return _round_cols(metrics.overall_metrics(per_job), set(_METRIC_COLS))


@register("filter_accuracy", f"""{_metrics_sql('rank')}
SELECT job_id, rater, CAST(rej AS BIGINT) AS rejected, round(acc, 6) AS filter_accuracy FROM fa2""")
def q_filter_accuracy(spark, sf_dir):
    vol = fx.brand_volume(spark, sf_dir)
    b, _ = fx.f2_ballots(spark, sf_dir, vol)
    m, _ = fx.f3_model_ballots(spark, sf_dir, vol)
    cons = consensus.consensus_ballots(b)
    both = b.select(*agreement.BALLOT_COLS).unionByName(metrics.model_as_ballot(m))
    return metrics.filter_accuracy(both, cons).select("job_id", "rater", "rejected",
                                                      round6("filter_accuracy").alias("filter_accuracy"))


@register("missing_model_jobs", f"""{W}
SELECT DISTINCT job_id FROM consensus WHERE job_id NOT IN (SELECT job_id FROM model)""")
def q_missing_model_jobs(spark, sf_dir):
    """J5 error path: jobs with a consensus but without a model result."""
    vol = fx.brand_volume(spark, sf_dir)
    b, _ = fx.f2_ballots(spark, sf_dir, vol)
    m, _ = fx.f3_model_ballots(spark, sf_dir, vol)
    return metrics.missing_model_jobs(consensus.consensus_ballots(b), m)


# ----------------------------------------------------------------- matrices

_ENTS = """, ents AS (SELECT job_id, rater, rater_ord, candidate, place, promising FROM ballots
                   UNION ALL SELECT * FROM model_b)"""


def _margins_sql(cells: str, key: str = "job_id") -> str:
    return f"""SELECT {key}, coalesce(entity_a, 'mean') AS entity_a, coalesce(entity_b, 'mean') AS entity_b,
       round(avg(value), 6) + 0.0 AS value
FROM {cells} GROUP BY GROUPING SETS (({key}, entity_a, entity_b), ({key}, entity_a), ({key}, entity_b), ({key}))"""


@register("footrule_matrix", f"""{W}
SELECT a.job_id, a.rater AS entity_a, b.rater AS entity_b, round(avg(abs(a.place - b.place)), 6) AS value
FROM ballots a JOIN ballots b USING (job_id, candidate) GROUP BY ALL""")
def q_footrule_matrix(spark, sf_dir):
    """E2 + E3: a pair metric of the caller's (mean difference of places), rounded by a cell transform."""
    b, _ = _ballots(spark, sf_dir)
    cells = agreement.pairwise_metric(b, F.avg(F.abs(F.col("place_a") - F.col("place_b"))))
    return matrices.transform_cells(cells, lambda c: F.round(c, 6))


@register("hamming_matrix", f"""{W}{_ENTS},{pairwise_sql('pw', 'ents', 'rank')},
cells AS (SELECT job_id, entity_a, entity_b, CAST(hamming AS DOUBLE) AS value FROM pw)
{_margins_sql('cells')}""")
def q_hamming_matrix(spark, sf_dir):
    cells = matrices.matrix_cells(agreement.pairwise(_entities(spark, sf_dir)), "hamming")
    return _round_cols(matrices.with_margins(cells), {"value"})


@register("tau_matrix_no_model", f"""{W},{pairwise_sql('pw', 'ballots', 'label_sequence')},
cells AS (SELECT job_id, entity_a, entity_b, tau AS value FROM pw)
{_margins_sql('cells')}""")
def q_tau_matrix_no_model(spark, sf_dir):
    pairs = agreement.pairwise(_entities(spark, sf_dir), "label_sequence")
    cells = matrices.matrix_cells(pairs, "tau", include_model=False)
    return _round_cols(matrices.with_margins(cells), {"value"})


@register("mean_tau_matrix", f"""{W}{_ENTS},{pairwise_sql('pw', 'ents', 'label_sequence')},
cells AS (SELECT 'mean' AS job_id, entity_a, entity_b, avg(tau) AS value FROM pw GROUP BY ALL)
{_margins_sql('cells')}""")
def q_mean_tau_matrix(spark, sf_dir):
    cells = matrices.matrix_cells(agreement.pairwise(_entities(spark, sf_dir), "label_sequence"), "tau")
    return _round_cols(matrices.with_margins(matrices.mean_matrix(cells)), {"value"})


@register("tau_distance_matrix", f"""{W}{_ENTS},{pairwise_sql('pw', 'ents', 'rank')}
SELECT job_id, entity_a, entity_b,
       CAST(floor((1.0 - tau) / 2 * (n * (n - 1) / 2) + 1e-9) AS DOUBLE) AS value FROM pw""")
def q_tau_distance_matrix(spark, sf_dir):
    pairs = agreement.pairwise(_entities(spark, sf_dir), "rank")
    cells = matrices.matrix_cells(pairs, "tau")
    size = pairs.filter(F.col("entity_a") == F.col("entity_b")).groupBy("job_id").agg(F.max("n").alias("n"))
    return matrices.tau_distance_cells(cells, size)


@register("matrix_shape", f"""{W}{_ENTS},
sets AS (SELECT job_id, string_agg(DISTINCT rater, '|' ORDER BY rater) AS entities FROM ents GROUP BY ALL)
SELECT entities, CAST(count(*) AS BIGINT) AS n_jobs FROM sets GROUP BY ALL""")
def q_matrix_shape(spark, sf_dir):
    cells = matrices.matrix_cells(agreement.pairwise(_entities(spark, sf_dir)), "hamming")
    return matrices.shape_report(cells)


@register("time_table", f"""{W}
SELECT coalesce(job_id, 'mean') AS job_id, coalesce(rater, 'mean') AS rater, round(avg(minutes), 6) AS minutes
FROM headers GROUP BY GROUPING SETS ((job_id, rater), (job_id), (rater), ())""")
def q_time_table(spark, sf_dir):
    _, h = _ballots(spark, sf_dir)
    return _round_cols(matrices.time_table(h), {"minutes"})


@register("model_time_table", f"""{W}
SELECT coalesce(job_id, 'mean') AS job_id, round(avg(seconds_taken / 60.0), 6) AS minutes
FROM run_info GROUP BY GROUPING SETS ((job_id), ())""")
def q_model_time_table(spark, sf_dir):
    _, info = fx.f3_model_ballots(spark, sf_dir)
    return _round_cols(matrices.model_time_table(info), {"minutes"})


@register("candidate_display_names", f"""{W},
nums AS (SELECT job_id, candidate, row_number() OVER (PARTITION BY job_id ORDER BY candidate) AS candidate_no
         FROM (SELECT DISTINCT job_id, candidate FROM ballots))
SELECT m.job_id, CAST(n.candidate_no AS BIGINT) AS candidate_no, n.candidate AS name, CAST(m.place AS BIGINT) AS place
FROM model m JOIN nums n USING (job_id, candidate)""")
def q_candidate_display_names(spark, sf_dir):
    """Model results keyed by candidate number get the display name from
    the ballot header positions (broadcast dimension built from the layout)."""
    from rankwise.operators.lookup import candidate_names
    _, layout = fx.f2_wide(spark, sf_dir)
    names = candidate_names(layout, spark)
    m, _ = fx.f3_model_ballots(spark, sf_dir)
    nums = names.select("job_id", "candidate_no", F.col("name").alias("candidate"))
    keyed = m.join(F.broadcast(nums), ["job_id", "candidate"]).select("job_id", "candidate_no", "place")
    return (keyed.join(F.broadcast(names), ["job_id", "candidate_no"])
            .select("job_id", F.col("candidate_no").cast("bigint").alias("candidate_no"), "name",
                    F.col("place").cast("bigint").alias("place")))
