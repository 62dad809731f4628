"""Extension points E2-E4, cells without common candidates, and message times."""

from datetime import datetime

from pyspark.sql import functions as F

from rankwise.operators import agreement, conversations, matrices, metrics

BALLOTS = ("job_id string, rater string, rater_ord int, candidate string, place int, promising boolean")


def test_pairs_without_a_common_candidate_have_a_cell(spark):
    b = spark.createDataFrame([("j", "a", 0, "x", 1, True), ("j", "b", 1, "y", 1, True), ("j", "c", 2, "x", 1, False)], BALLOTS)
    got = {(r.entity_a, r.entity_b): (r.hamming, r.tau, r.n) for r in agreement.pairwise(b).collect()}
    assert len(got) == 9 and got["a", "b"] == got["b", "a"] == (2, None, 0) and got["a", "c"] == (1, None, 1)


def test_any_pair_metric_and_cell_transform(spark):
    b = spark.createDataFrame([("j", "a", 0, "x", 1, True), ("j", "a", 0, "y", 2, False), ("j", "b", 1, "x", 2, True),
                               ("j", "b", 1, "y", 1, True)], BALLOTS)
    same = agreement.pairwise_metric(b, F.avg((F.col("promising_a") == F.col("promising_b")).cast("double")))
    cells = matrices.transform_cells(same, lambda c: 1 - c)
    assert {(r.entity_a, r.entity_b): r.value for r in cells.collect()} == {
        ("a", "a"): 0.0, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 0.0}


def test_measures_and_directions_are_arguments(spark):
    human = spark.createDataFrame([("j", 0.2, 5.0), ("j", 0.6, 1.0)], "job_id string, tau double, cost double")
    model = spark.createDataFrame([("j", 0.4, 1.0)], "job_id string, tau double, cost double")
    got = metrics.better_or_equal(model, human, {"tau_share": ("tau", True), "cheap_share": ("cost", False)}).first()
    assert (got.tau_share, got.cheap_share) == (0.5, 1.0)


def test_message_times(spark):
    t = datetime(2024, 1, 1)
    conv = spark.createDataFrame([(1, 0, "user", " hi ", t), (1, 1, "assistant", "yes", t.replace(microsecond=1)),
                                  (2, 0, "system", "x", t)], "conv_id long, turn int, role string, text string, at timestamp")
    got = {(r.conv_id, r.turn): (r.author, r.text, r.elapsed) for r in conversations.message_records(conv, "at").collect()}
    assert got == {(1, 0): ("user", "hi", None), (1, 1): ("model", "yes", 1), (2, 0): ("system", "x", None)}
