"""Named files, questionnaire files, typed readers and the judge's answer table."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankwise.operators import answers as ans
from rankwise.sinks import records as sinks
from rankwise.sources import files


def test_named_files(spark, tmp_dir):
    rows = spark.createDataFrame([("job_1/applicants/candidate_1.txt", "café"), ("job_1/applicants/candidate_2.TXT", None),
                                  ("job_1/job_description.txt", ""), ("top.json", "{}")], "path string, content string")
    for root in (tmp_dir, "file:" + tmp_dir):  # as a path and as Spark names it; a second run leaves the same files
        sinks.write_files(rows, root)
    found = sorted(os.path.relpath(os.path.join(d, f), tmp_dir) for d, _, fs in os.walk(tmp_dir) for f in fs if not f.endswith(".crc"))
    assert found == ["job_1/applicants/candidate_1.txt", "job_1/applicants/candidate_2.TXT", "job_1/job_description.txt", "top.json"]
    got = {(r.kind, r.candidate_no): (r.text, r.length) for r in files.scan_documents(spark, tmp_dir).collect()}
    assert got == {("candidate", 1): ("café", 5)}  # Spark's file sources pass over files without a byte


def test_an_unfinished_file_is_not_scanned(spark, tmp_dir):
    sinks.write_files(spark.createDataFrame([("job_1/candidate_1.txt", "whole")], "path string, content string"), tmp_dir)
    with open(f"{tmp_dir}/job_1/_candidate_1.txt.0123abcd", "w") as f:
        f.write("half")
    assert [r.text for r in files.scan_documents(spark, tmp_dir).collect()] == ["whole"]


def test_tasks_of_a_scan_do_not_grow_with_its_files(spark, tmp_dir):
    """Every file is a partition of its own here; the tasks share the partitions out and no file is lost."""
    most = files.SCAN_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    n = most + 60
    rows = spark.range(n).selectExpr("concat('job_', id % 3, '/applicants/candidate_', id, '.txt') AS path", "cast(id AS string) AS content")
    sinks.write_files(rows, tmp_dir)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        for scan in (files.scan_documents(spark, tmp_dir), files.scan_documents(spark, tmp_dir, with_content=False)):
            assert scan.rdd.getNumPartitions() <= most
        got = {(r.candidate_no, r.text) for r in files.scan_documents(spark, tmp_dir).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert got == {(i, str(i)) for i in range(n)}


def test_questionnaire_of_quotes_commas_and_blanks(spark, tmp_dir):
    wide = spark.createDataFrame([(1, "2025/05/02 10:00:00 AM GMT+1", 3, 'Ann "A" Berg', 2, 1), (0, "2025/05/02 9:00:00 AM GMT+1", None, None, 1, None)],
                                 "k int, at string, m int, p string, x int, y int")
    layout = [{"job_id": "a", "minutes": "m", "promising": "p", "places": [("x", 'Place of Ann "A" Berg'), ("y", "Place of Poe, Carl")]}]
    sinks.write_ballot_csv(wide, layout, f"{tmp_dir}/form", "at", "k")
    lines = [r.value for r in spark.read.text(f"{tmp_dir}/form").collect()]
    assert len(lines) == 3 and lines[0].startswith("Timestamp") and lines[1].startswith("2025/05/02 9:")
    ballots, headers = files.read_ballot_csv(spark, f"{tmp_dir}/form", block=4)
    got = {(r.rater_ord, r.candidate): (r.place, r.promising) for r in ballots.collect()}
    assert got == {(0, 'Ann "A" Berg'): (1, False), (0, "Poe, Carl"): (None, False), (1, 'Ann "A" Berg'): (2, True), (1, "Poe, Carl"): (1, False)}
    assert {r.rater_ord: r.minutes for r in headers.collect()} == {0: None, 1: 3.0}


def test_overview_keeps_text_columns(spark, tmp_dir):
    ov = spark.createDataFrame([("a", 1, 1, True, 70.0, None, "007", 3)], "job_id string, candidate_id long, place int, promising boolean, "
                               "total_score double, `score (education)` double, code string, hits long")
    sinks.write_overview(ov, f"{tmp_dir}/o")
    r = files.read_overview(spark, f"{tmp_dir}/o", {"hits": "bigint"}).first()
    assert (r["score (education)"], r.code, r.hits, r.place) == (None, "007", 3, 1)


def test_report_without_a_value(spark, tmp_dir):
    per_job = spark.createDataFrame([("a", 0.5, None), ("b", 1.0, 2.0)], "job_id string, m double, n double")
    sinks.write_report(per_job, per_job.agg(F.avg("m").alias("m"), F.avg("n").alias("n")), f"{tmp_dir}/r")
    got = {(r.scope, r.job_id, r.metric): r.value for r in files.read_report(spark, f"{tmp_dir}/r").collect()}
    assert got == {("job", "a", "m"): 0.5, ("job", "b", "m"): 1.0, ("job", "b", "n"): 2.0, ("overall", None, "m"): 0.75, ("overall", None, "n"): 2.0}


def _judge(log):
    def fn(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if "bad" in set(texts):
            raise KeyError("bad")
        return [None if t == "mute" else t.upper() for t in texts]
    return fn


def test_judge_asks_only_what_is_new(spark, tmp_dir):
    requests = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, "bad"), (5, "mute"), (6, None)], "id int, text string")
    store = f"{tmp_dir}/answers"
    first = ans.judge(requests.where("id < 5"), "text", _judge(f"{tmp_dir}/log1"), store, callers=1, tries=2)
    got = {r.id: (r.answer, r.reason, r.run) for r in first.collect()}
    assert got == {1: ("ONE", None, 1), 2: ("TWO", None, 1), 3: ("ONE", None, 1), 4: (None, "failed: KeyError", 1)}
    first.collect()  # a second action reads the answers, it doesn't ask
    with open(f"{tmp_dir}/log1") as f:
        asked = f.read().split()
    assert asked.count("bad") == 3 and asked.count("one") <= 2
    second = ans.judge(requests, "text", _judge(f"{tmp_dir}/log2"), store, callers=1, tries=2)
    got = {r.id: (r.answer, r.reason, r.run) for r in second.collect()}
    assert got == {1: ("ONE", None, 1), 2: ("TWO", None, 1), 3: ("ONE", None, 1), 4: (None, "failed: KeyError", 2),
                   5: (None, "no_answer", 2), 6: ("", None, 2)}
    with open(f"{tmp_dir}/log2") as f:
        assert not {"one", "two"} & set(f.read().split())


def test_judge_of_a_wrong_number_of_answers():
    answers, reasons, tries = ans._asked(lambda texts: ["x"] * (len(texts) if len(texts) == 1 else 7), pd.Series(["a", "b"]), 2)
    assert (answers, reasons, tries) == (["x", "x"], [None, None], [1, 1])
    assert ans._asked(lambda texts: [None], pd.Series(["a"]), 2) == ([None], ["no_answer"], [1])


@pytest.mark.parametrize("tries", [1, 3])
def test_judge_of_nothing(spark, tmp_dir, tries):
    none = spark.createDataFrame([], "id int, text string")
    assert ans.judge(none, "text", lambda t: t, f"{tmp_dir}/s", tries=tries).count() == 0
