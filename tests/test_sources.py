"""File sources and sinks on temporary trees."""

import json
import os

from pyspark.sql import functions as F

from rankwise.operators import ballots as bl
from rankwise.sinks import records as sinks
from rankwise.sources import files


def _write(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def test_document_tree(spark, tmp_dir):
    for job, cands in ((1, (1, 2)), (10, (1,)), (2, ())):
        for c in cands:
            _write(f"{tmp_dir}/job_{job}/applicants/candidate_{c}.txt", f"cv {job}-{c}")
        _write(f"{tmp_dir}/job_{job}/applicants/candidate_9.png", "img")
    _write(f"{tmp_dir}/job_1/job_description.txt", "jd txt")
    _write(f"{tmp_dir}/job_1/job_description.docx", "jd docx")
    _write(f"{tmp_dir}/job_2/job_description.pdf", "jd pdf")
    scan = files.scan_documents(spark, tmp_dir)
    cands = files.candidate_documents(scan)
    assert sorted((r["job_no"], r["candidate_no"]) for r in cands.collect()) == [(1, 1), (1, 2), (10, 1)]
    assert {r["text"] for r in cands.collect()} == {"cv 1-1", "cv 1-2", "cv 10-1"}
    exact = files.select_paths(cands, jobs=[1])
    sub = files.select_paths(cands, jobs=[1], match="substring")
    assert exact.count() == 2 and sub.count() == 3            # job_1 also selects job_10
    best, missing = files.resolve_job_documents(scan)
    assert {r["job_no"]: r["suffix"] for r in best.collect()} == {1: "docx", 2: "pdf"}
    assert [r["job_no"] for r in missing.collect()] == [10]
    chk = {r["job_no"]: r["valid"] for r in files.workload_checks(best, cands).collect()}
    assert chk == {1: True, 2: False, 10: False}
    assert files.workloads(best, cands).count() == 2
    assert files.scan_documents(spark, tmp_dir, jobs=[10]).count() == 1


def test_names_and_equal_numbers(spark, tmp_dir):
    """Candidates need no number; two trees may have a job of the same number."""
    for tree, suffix in (("x", "txt"), ("y", "pdf")):
        _write(f"{tmp_dir}/{tree}/job_1/applicants/candidate_anna.{suffix}", tree)
        _write(f"{tmp_dir}/{tree}/job_1/job_description.{suffix}", tree)
    scan = files.scan_documents(spark, tmp_dir)
    cands = files.candidate_documents(scan)
    assert sorted((r["candidate_name"], r["candidate_no"], r["suffix"]) for r in cands.collect()) == [
        ("anna", None, "pdf"), ("anna", None, "txt")]
    best, missing = files.resolve_job_documents(scan)
    assert sorted(r["suffix"] for r in best.collect()) == ["pdf", "txt"] and missing.count() == 0
    pairs = files.workloads(best, cands).collect()
    assert len(pairs) == 2 and all(r["candidate_path"].split("/")[-4] == r["job_path"].split("/")[-3] for r in pairs)


def test_wide_ballot_csv(spark, tmp_dir):
    names = ["Anna Berg", "Carl Dorn", "Eva Falk"]
    header = ["Timestamp"]
    for _ in range(2):
        header += ["Minutes for this job?", "Promising candidates?"] + [f"Place of {n}" for n in names]
    rows = [["2025/05/02 7:15:09 AM GMT+1", "20", "Anna Berg;Carl Dorn;Anna Berg", "1", "2", "3",
             "10", "Eva Falk", "3", "2", "1"],
            ["2025/05/02 9:30:00 AM GMT+1", "30", "Carl Dorn", "2", "1", "3", "12", "", "1", "2", "3"]]
    path = f"{tmp_dir}/ballots.csv"
    import csv
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    ballots, headers = files.read_ballot_csv(spark, path, block=5)
    got = sorted((r["job_id"], r["rater_ord"], r["candidate"], r["place"], r["promising"]) for r in ballots.collect())
    assert ("1", 0, "Anna Berg", 1, True) in got and ("1", 1, "Carl Dorn", 1, True) in got
    assert ("2", 0, "Eva Falk", 1, True) in got and len(got) == 12
    mins = {(r["job_id"], r["rater_ord"]): r["minutes"] for r in headers.collect()}
    assert mins == {("1", 0): 20.0, ("1", 1): 30.0, ("2", 0): 10.0, ("2", 1): 12.0}
    checks = {(r["job_id"], r["rater"]): r["valid"] for r in bl.ballot_checks(ballots, headers).collect()}
    assert all(checks.values())


def test_result_tables_and_config(spark, tmp_dir):
    for j, secs in ((1, 61), (2, 30)):
        _write(f"{tmp_dir}/job_{j}/result/job_match_result.csv",
               "candidate,promising,total_score\ncandidate_2,true,70.5\ncandidate_1,false,40.25\n")
        _write(f"{tmp_dir}/job_{j}/result/additional_info.json", json.dumps({"seconds_taken": secs}))
    res, info = files.read_model_results(spark, tmp_dir)
    assert sorted((r["job_no"], r["candidate"], r["place"]) for r in res.collect()) == [
        (1, "candidate_1", 2), (1, "candidate_2", 1), (2, "candidate_1", 2), (2, "candidate_2", 1)]
    assert {r["job_no"]: r["seconds_taken"] for r in info.collect()} == {1: 61, 2: 30}
    cfg = {"generic_config": {"job_requirements_config": {
        "work_experience": {"definition": "w", "weighting": 60}, "education": {"definition": "e", "weighting": 40}}}}
    _write(f"{tmp_dir}/config.json", json.dumps(cfg, indent=2))
    types = files.read_requirement_types(spark, f"{tmp_dir}/config.json").orderBy("ord").collect()
    assert [(r["type"], r["ord"], r["weighting"]) for r in types] == [("work_experience", 0, 60), ("education", 1, 40)]


def test_sinks_round_trip(spark, tmp_dir):
    ov = spark.createDataFrame([("a", 1, 1, True, 70.123), ("a", 2, 2, False, 40.0), ("b", 3, 1, True, 55.555)],
                               "job_id string, candidate_id long, place int, promising boolean, total_score double")
    sinks.write_overview(ov, f"{tmp_dir}/overview")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/overview")
    assert back.count() == 3 and {r["job_id"] for r in back.collect()} == {"a", "b"}
    assert {r["total_score"] for r in back.collect()} == {"70.12", "40.0", "55.56"}
    cells = spark.createDataFrame([("a", "x", "y", 1.23456), ("mean", "x", "y", 1.23456)],
                                  "job_id string, entity_a string, entity_b string, value double")
    sinks.write_matrices(cells, f"{tmp_dir}/m", "tau")
    vals = {r["job_id"]: r["value"] for r in spark.read.option("header", True).csv(f"{tmp_dir}/m").collect()}
    assert vals == {"a": "1.23", "mean": "1.235"}
    per_job = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "job_id string, m double")
    rep = {r["scope"] + str(r["job_id"]): json.loads(r["metrics"])
           for r in sinks.report(per_job, per_job.agg(F.avg("m").alias("m"))).collect()}
    assert rep == {"joba": {"m": 0.5}, "jobb": {"m": 1.0}, "overallNone": {"m": 0.75}}
    recs = spark.createDataFrame([("a", 1, '{"x":1}')], "job_id string, candidate_id long, record string")
    resp = {(r["job_id"], r["candidate_id"]): r["record"] for r in sinks.combined_response(ov, recs).collect()}
    assert resp == {("a", 1): '{"x":1}', ("a", 2): None, ("b", 3): None}
    again = files.read_overview(spark, f"{tmp_dir}/overview")
    assert sorted((r["job_id"], r["candidate_id"], r["place"], r["promising"], r["total_score"]) for r in again.collect()) == [
        ("a", 1, 1, True, 70.12), ("a", 2, 2, False, 40.0), ("b", 3, 1, True, 55.56)]
    sinks.write_records(recs, f"{tmp_dir}/records")
    assert [(r["job_id"], r["candidate_id"], r["record"]) for r in spark.read.json(f"{tmp_dir}/records").collect()] == [
        ("a", 1, '{"x":1}')]
    sinks.write_report(per_job, per_job.agg(F.avg("m").alias("m")), f"{tmp_dir}/report")
    assert spark.read.json(f"{tmp_dir}/report").count() == 3
    pairs = spark.createDataFrame([("a", 1.2), ("a", 3.1)], "job_id string, seconds double")
    sinks.write_run_info(pairs, f"{tmp_dir}/info")
    assert [(r["job_id"], r["seconds_taken"]) for r in spark.read.json(f"{tmp_dir}/info").collect()] == [("a", 5)]
