"""Scoring: the reference's one unit test (57.5) plus edge cases and properties."""

from pyspark.sql import functions as F

from rankwise.operators import native_scorer as ns
from rankwise.operators import scoring
from rankwise.schemas import requirement_types


def _scores(spark, rows):
    return spark.createDataFrame(rows, "job_id string, candidate_id long, type string, kind string, score int")


def test_total_score_golden(spark):
    rows = [("j", 1, "work_experience", "mandatory", 60), ("j", 1, "work_experience", "mandatory", 40),
            ("j", 1, "education", "mandatory", 70)]
    t = scoring.weighted_totals(_scores(spark, rows), requirement_types(spark)).first()
    assert t["total_score"] == 57.5


def test_no_requirements_gives_minimum(spark):
    s = _scores(spark, [("j", 1, "education", "optional", 80)])
    cands = spark.createDataFrame([("j", 1), ("j", 2)], "job_id string, candidate_id long")
    t = {r["candidate_id"]: r["total_score"] for r in
         scoring.weighted_totals(s, requirement_types(spark), candidates=cands).collect()}
    assert t == {1: 80.0, 2: 0.0}


def test_clamp_and_range_check(spark):
    raw = spark.createDataFrame([(-8,), (50,), (115,)], "raw_score int")
    got = [r["score"] for r in scoring.clamp_scores(raw).orderBy("raw_score").collect()]
    assert got == [0, 50, 100]
    viol = scoring.score_range_violations(raw.withColumn("score", F.col("raw_score")))
    assert viol.count() == 2


def test_total_within_range_and_monotone(spark):
    rows = [("j", 1, "work_experience", "mandatory", 10), ("j", 1, "languages", "optional", 90)]
    base = scoring.weighted_totals(_scores(spark, rows), requirement_types(spark)).first()["total_score"]
    raised = scoring.weighted_totals(_scores(spark, [rows[0], ("j", 1, "languages", "optional", 100)]),
                                     requirement_types(spark)).first()["total_score"]
    assert 0 <= base <= 100 and raised >= base


def test_overview_ranks_every_candidate(spark):
    rows = [("j", c, "education", "mandatory", (c * 37) % 101) for c in range(1, 40)] + \
           [("k", c, "travel", "optional", (c * 11) % 101) for c in range(1, 10)]
    s = _scores(spark, rows)
    names = [t for t, _ in __import__("rankwise.schemas", fromlist=["x"]).REQUIREMENT_TYPES]
    cands = s.select("job_id", "candidate_id").union(spark.createDataFrame([("j", 99), ("m", 1)], "job_id string, candidate_id long"))
    o = scoring.overview(s, requirement_types(spark), names, candidates=cands)
    got = sorted((r["job_id"], r["place"], r["candidate_id"]) for r in o.collect())
    by_job = {"j": {c: (c * 37) % 101 for c in range(1, 40)} | {99: 0}, "k": {c: (c * 11) % 101 for c in range(1, 10)}, "m": {1: 0}}
    # every mandatory type mean reaches 25 for k (no mandatory requirement) and for candidates without scores
    want = []
    for j, sc in by_job.items():
        promising = {c: v >= 50 for c, v in sc.items()}
        order = sorted(sc, key=lambda c: (not promising[c], -sc[c], c))
        want += [(j, i + 1, c) for i, c in enumerate(order)]
    assert got == sorted(want)
    none = o.filter("candidate_id = 99").first()
    assert none["total_score"] == 0.0 and none["score (education)"] is None


def test_coarse_to_fine_shortlist(spark):
    """Keeping everyone equals scoring all; the coarse score orders by shared words; nulls, empty texts and jobs without words."""
    from rankwise.operators import described
    from rankwise.operators.native_scorer import overlap_scores
    reqs = spark.createDataFrame([("a", 1, "spark sql joins"), ("a", 2, "sql"), ("b", 3, ""), ("c", 4, "rust")],
                                 "job_id string, requirement_id int, specification string")
    docs = spark.createDataFrame([("a", 1, "sql and spark sql joins"), ("a", 2, "sql"), ("a", 3, None), ("a", 4, ""), ("a", 5, "joins of spark"),
                                  ("b", 6, "x"), ("b", 7, "y"), ("d", 8, "sql")], "job_id string, candidate_id int, text string")
    coarse = {(r.job_id, r.candidate_id): r.coarse for r in described.coarse_scores(reqs, docs).collect()}
    third = 1_000_000 // 3
    assert coarse == {("a", 1): 3 * third + 1_000_000, ("a", 2): third + 1_000_000, ("a", 3): 0, ("a", 4): 0, ("a", 5): 2 * third,
                      ("b", 6): 0, ("b", 7): 0, ("d", 8): 0}
    rows = lambda df: sorted((r.job_id, r.candidate_id, r.rank, r.mean_score) for r in df.collect())
    assert rows(described.shortlist_coarse_to_fine(reqs, docs, 3, 100)) == rows(described.shortlist(overlap_scores(reqs, docs), 3))
    few = rows(described.shortlist_coarse_to_fine(reqs, docs, 3, 1))
    assert [(j, c) for j, c, _, _ in few] == [("a", 1), ("b", 6)]


def test_document_ngrams_are_built_in_their_rows(spark):
    """No token of a document is sorted or exchanged; rows that repeat a key are still one document."""
    reqs = spark.createDataFrame([("j", 1, "a b c d"), ("j", 2, "c d x"), ("k", 1, "a"), ("j", 3, "")], "job_id string, requirement_id int, specification string")
    docs = spark.createDataFrame([("j", 1, "A b, c d e"), ("j", 2, "a b"), ("j", 2, "a b"), ("k", 1, None), ("k", None, "a"), (None, 7, "a b")],
                                 "job_id string, candidate_id int, text string")
    plan = ns.row_ngrams(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    rows = {(r.job_id, r.requirement_id, r.candidate_id): r.hits for r in ns.overlap_scores(reqs, docs).distinct().collect()}
    assert rows == {("j", 1, 1): 9, ("j", 2, 1): 3, ("j", 3, 1): 0, ("j", 1, 2): 3, ("j", 2, 2): 0, ("j", 3, 2): 0, ("k", 1, 1): 0, ("k", 1, None): 0}
    whole = ns.requirement_ngrams(reqs).selectExpr("job_id", "ngram").distinct()
    vocab = whole.where("ngram not like '% %'").withColumnRenamed("ngram", "token")
    one = docs.where("candidate_id = 1")
    same = ns.row_ngrams(one).join(whole, ["job_id", "ngram"]).select("job_id", "candidate_id", "ngram")
    want = ns.document_ngrams(one, vocab).join(whole, ["job_id", "ngram"]).select("job_id", "candidate_id", "ngram")
    assert same.exceptAll(want).count() == want.exceptAll(same).count() == 0 and same.count() == 9


def test_pivot_is_one_aggregate_over_the_statistics(spark):
    """No aggregate of arrays: the statistics and one aggregate of doubles; nulls of key, type and score as before."""
    rows = [("j", 1, "a", "mandatory", 10), ("j", 1, "a", "optional", 21), ("j", 1, "b", "optional", None), ("j", 2, None, "optional", 5),
            (None, None, "b", "optional", 7), ("j", 3, "other", "optional", 9)]
    out = scoring.category_pivot(spark.createDataFrame(rows, "job_id string, candidate_id int, type string, kind string, score int"), ["a", "b"])
    assert out.columns == ["job_id", "candidate_id", "score (a)", "score (b)"]
    assert {tuple(r) for r in out.collect()} == {("j", 1, 15.5, None), ("j", 2, None, None), (None, None, None, 7.0), ("j", 3, None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
