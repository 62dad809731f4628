"""Scoring queries on adapter F1 (clamp, category means, totals, ranking)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwise.functions.columns import round6
from rankwise.operators import scoring
from rankwise.operators.ranking import desc, prefix_count, rank_within
from rankwise.plans import fixtures as fx
from rankwise.plans.oracle import F1_SQL
from rankwise.plans.registry import register
from rankwise.schemas import requirement_types
from rankwise.sources.tables import table


def _scores(spark, sf_dir):
    return scoring.clamp_scores(fx.f1_requirement_scores(spark, sf_dir))


# ---------------------------------------------------------------- scoring (F1)

@register("clamped_scores", f"""WITH {F1_SQL}
SELECT job_id, candidate_id, type, kind, CAST(raw_score AS BIGINT) AS raw_score, CAST(score AS BIGINT) AS score
FROM scores""")
def q_clamped_scores(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.select("job_id", "candidate_id", "type", "kind", F.col("raw_score").cast("bigint").alias("raw_score"),
                    F.col("score").cast("bigint").alias("score"))


@register("category_means", f"""WITH {F1_SQL}
SELECT job_id, candidate_id, type, CAST(n AS BIGINT) AS n_scores, round(CAST(s AS DOUBLE) / n, 6) AS mean_score
FROM cat""")
def q_category_means(spark, sf_dir):
    m = scoring.category_means(_scores(spark, sf_dir))
    return m.select("job_id", "candidate_id", "type", F.col("n_scores").cast("bigint").alias("n_scores"),
                    round6("mean_score").alias("mean_score"))


@register("weighted_totals", f"""WITH {F1_SQL}
SELECT job_id, candidate_id, round(total_score, 6) AS total_score FROM totals""")
def q_weighted_totals(spark, sf_dir):
    t = scoring.weighted_totals(_scores(spark, sf_dir), requirement_types(spark))
    return t.select("job_id", "candidate_id", round6("total_score").alias("total_score"))


@register("score_range_violations", f"""WITH {F1_SQL}
SELECT job_id, candidate_id, type, CAST(raw_score AS BIGINT) AS score FROM f1 WHERE raw_score < 0 OR raw_score > 100""")
def q_score_range_violations(spark, sf_dir):
    """P8 on the raw answers, before any clamp."""
    raw = fx.f1_requirement_scores(spark, sf_dir).withColumnRenamed("raw_score", "score")
    v = scoring.score_range_violations(raw)
    return v.select("job_id", "candidate_id", "type", F.col("score").cast("bigint").alias("score"))


@register("line_places", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                                             l_shipdate) AS place,
       CAST(count(*) FILTER (WHERE l_linestatus = 'F') OVER (PARTITION BY l_returnflag
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS filled_before
FROM lineitem""")
def q_line_places(spark, sf_dir):
    """W1 and running counts over three hot groups: every row of ``lineitem``."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # line numbers repeat within orders of these tables
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *ids, "l_extendedprice", "l_linestatus", "l_shipdate")
    out = rank_within(li, ["l_returnflag"], [desc("l_extendedprice"), *ids, "l_shipdate"])
    out = prefix_count(out, ["l_returnflag"], ["l_shipdate", *ids, "l_extendedprice"], F.col("l_linestatus") == "F", "filled_before")
    return out.select("l_returnflag", *ids, "place", "filled_before")


def _pivot_sql_cols() -> str:
    return ", ".join(
        f"round(CAST(sum(s) FILTER (WHERE type = '{t}') AS DOUBLE) / sum(n) FILTER (WHERE type = '{t}'), 6) "
        f"AS \"score ({t})\"" for t in fx.TYPE_NAMES)


@register("category_pivot", f"""WITH {F1_SQL}
SELECT job_id, candidate_id, {_pivot_sql_cols()} FROM cat GROUP BY ALL""")
def q_category_pivot(spark, sf_dir):
    w = scoring.category_pivot(_scores(spark, sf_dir), fx.TYPE_NAMES)
    return w.select("job_id", "candidate_id", *[round6(f"`score ({t})`").alias(f"score ({t})") for t in fx.TYPE_NAMES])


@register("ranked_overview", f"""WITH {F1_SQL}, piv AS (
  SELECT job_id, candidate_id, {_pivot_sql_cols()} FROM cat GROUP BY ALL
)
SELECT d.job_id, d.candidate_id,
       CAST(row_number() OVER (PARTITION BY d.job_id ORDER BY d.promising DESC, d.total_score DESC, d.candidate_id)
            AS BIGINT) AS place,
       d.promising, round(d.total_score, 6) AS total_score, {", ".join(f'p."score ({t})"' for t in fx.TYPE_NAMES)}
FROM decided d LEFT JOIN piv p USING (job_id, candidate_id)""")
def q_ranked_overview(spark, sf_dir):
    o = scoring.overview(_scores(spark, sf_dir), requirement_types(spark), fx.TYPE_NAMES)
    return o.select("job_id", "candidate_id", F.col("place").cast("bigint").alias("place"), "promising",
                    round6("total_score").alias("total_score"),
                    *[round6(f"`score ({t})`").alias(f"score ({t})") for t in fx.TYPE_NAMES])
