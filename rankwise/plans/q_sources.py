"""Document-tree queries on the path adapter F4 (S1-S4, P6) and the
job-name lookup (P9) / candidate display names (J10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwise.plans import fixtures as fx
from rankwise.plans.oracle import F4_SQL
from rankwise.plans.registry import register
from rankwise.sources import files
from rankwise.sources.tables import table


def _parsed(spark, sf_dir):
    return files.parse_paths(fx.f4_paths(spark, sf_dir))


@register("candidate_paths", f"""WITH {F4_SQL}
SELECT path, job_no, candidate_no, suffix FROM cands""")
def q_candidate_paths(spark, sf_dir):
    return files.candidate_documents(_parsed(spark, sf_dir)).select("path", "job_no", "candidate_no", "suffix")


@register("selected_paths_exact", f"""WITH {F4_SQL}
SELECT path, job_no, candidate_no FROM cands WHERE job_no IN (1, 2)""")
def q_selected_paths_exact(spark, sf_dir):
    s = files.select_paths(files.candidate_documents(_parsed(spark, sf_dir)), jobs=[1, 2])
    return s.select("path", "job_no", "candidate_no")


@register("selected_paths_substring", f"""WITH {F4_SQL}
SELECT path, job_no, candidate_no FROM cands WHERE contains(path, 'job_1') OR contains(path, 'job_2')""")
def q_selected_paths_substring(spark, sf_dir):
    s = files.select_paths(files.candidate_documents(_parsed(spark, sf_dir)), jobs=[1, 2], match="substring")
    return s.select("path", "job_no", "candidate_no")


@register("job_documents", f"""WITH {F4_SQL}
SELECT job_no, job_path, suffix FROM best""")
def q_job_documents(spark, sf_dir):
    best, _ = files.resolve_job_documents(_parsed(spark, sf_dir))
    return best.select("job_no", "job_path", "suffix")


@register("missing_job_documents", f"""WITH {F4_SQL}
SELECT DISTINCT job_no, 'no_job_description' AS reason FROM cands WHERE job_no NOT IN (SELECT job_no FROM best)""")
def q_missing_job_documents(spark, sf_dir):
    _, missing = files.resolve_job_documents(_parsed(spark, sf_dir))
    return missing.select("job_no", "reason")


@register("workloads", f"""WITH {F4_SQL}
SELECT c.job_no, c.candidate_no, c.path AS candidate_path, b.job_path FROM cands c JOIN best b USING (job_no)""")
def q_workloads(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    best, _ = files.resolve_job_documents(p)
    return files.workloads(best, files.candidate_documents(p))


@register("workload_checks", f"""WITH {F4_SQL},
j AS (SELECT job_no, count(*) AS n_job_docs FROM best GROUP BY ALL),
c AS (SELECT job_no, count(*) AS n_candidates FROM cands GROUP BY ALL)
SELECT coalesce(j.job_no, c.job_no) AS job_no, CAST(coalesce(n_job_docs, 0) AS BIGINT) AS n_job_docs,
       CAST(coalesce(n_candidates, 0) AS BIGINT) AS n_candidates,
       coalesce(n_job_docs, 0) = 1 AND coalesce(n_candidates, 0) >= 1 AS valid
FROM j FULL JOIN c ON j.job_no = c.job_no""")
def q_workload_checks(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    best, _ = files.resolve_job_documents(p)
    out = files.workload_checks(best, files.candidate_documents(p))
    return out.select("job_no", F.col("n_job_docs").cast("bigint").alias("n_job_docs"),
                      F.col("n_candidates").cast("bigint").alias("n_candidates"), "valid")


@register("job_name_lookup", """
WITH m AS (SELECT c_nationkey AS job_no, n_name AS job_name FROM customer JOIN nation ON c_nationkey = n_nationkey
           GROUP BY ALL)
SELECT job_no, job_name, (SELECT count(*) FROM m m2 WHERE m2.job_name = m.job_name) = 1
       AND (SELECT count(*) FROM m m3 WHERE m3.job_no = m.job_no) = 1 AS unique_match FROM m""")
def q_job_name_lookup(spark, sf_dir):
    """Each job name names exactly one job folder and vice versa."""
    from rankwise.operators.lookup import unique_lookup
    cust = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("job_no"))
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job_no"), F.col("n_name").alias("job_name"))
    return unique_lookup(cust.join(nat, "job_no").distinct(), "job_no", "job_name")
