"""Consensus: majority set, first-seen mode and four-key ranking."""

from rankwise.operators import consensus


def _b(spark, rows):
    return spark.createDataFrame(rows, "job_id string, rater string, rater_ord int, candidate string, "
                                       "place int, promising boolean")


def test_exactly_half_is_out(spark):
    rows = [("j", "a", 0, "x", 1, True), ("j", "b", 1, "x", 1, False),
            ("j", "a", 0, "y", 2, True), ("j", "b", 1, "y", 2, True)]
    m = {r["candidate"]: r["in_majority"] for r in consensus.majority_set(_b(spark, rows)).collect()}
    assert m == {"x": False, "y": True}


def test_first_seen_mode_on_ties(spark):
    # candidate x: places 3 (rater 0), 1 (rater 1) -> tie, first seen is 3
    rows = [("j", "a", 0, "x", 3, False), ("j", "b", 1, "x", 1, False)]
    assert consensus.first_seen_mode(_b(spark, rows)).first()["mode_place"] == 3


def test_identical_ballots_give_that_ballot(spark):
    order = ["c3", "c1", "c2", "c4"]
    rows = [("j", r, i, c, p + 1, p < 2) for i, r in enumerate(["a", "b", "c"]) for p, c in enumerate(order)]
    cons = consensus.consensus_ballots(_b(spark, rows)).orderBy("place").collect()
    assert [r["candidate"] for r in cons] == order
    assert [r["promising"] for r in cons] == [True, True, False, False]


def test_ties_broken_by_four_keys_then_first_seen(spark):
    # x and y both mean 1.5, mode: x -> 1 (first seen), y -> 2; so x first
    rows = [("j", "a", 0, "x", 1, True), ("j", "a", 0, "y", 2, True),
            ("j", "b", 1, "x", 2, True), ("j", "b", 1, "y", 1, True)]
    r = consensus.consensus_ranking(_b(spark, rows)).orderBy("place").collect()
    assert [x["candidate"] for x in r] == ["x", "y"]
