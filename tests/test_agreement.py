"""Kendall's tau (both definitions), Hamming, exact discordant counting."""

import itertools
import random

import pytest

from rankwise.operators import agreement, matrices

BASE = ["dog", "cat", "mom", "tennis"]
# worked examples: (second ranking, tau rank mode, tau label-sequence mode)
EXAMPLES = [
    (["dog", "cat", "mom", "tennis"], 1.0, 1.0),
    (["tennis", "mom", "cat", "dog"], -1.0, -1 / 3),
    (["cat", "mom", "tennis", "dog"], 0.0, 0.0),
    (["cat", "dog", "mom", "tennis"], 2 / 3, 2 / 3),
]


def _ballots(spark, rankings):
    rows = []
    for r, (name, order) in enumerate(rankings):
        for place, cand in enumerate(order, start=1):
            rows.append(("j", name, r, cand, place, place <= 2))
    return spark.createDataFrame(rows, "job_id string, rater string, rater_ord int, candidate string, "
                                       "place int, promising boolean")


@pytest.mark.parametrize("method,idx", [("rank", 1), ("label_sequence", 2)])
def test_worked_examples(spark, method, idx):
    for ex in EXAMPLES:
        b = _ballots(spark, [("a", ex[0])])
        ref = _ballots(spark, [("ref", BASE)])
        tau = agreement.compare_to_reference(b, ref, method).first()["tau"]
        assert tau == pytest.approx(ex[idx]), (method, ex)


def _brute(a, b):
    n = len(a)
    return sum(1 for i, j in itertools.combinations(range(n), 2) if (a[i] - a[j]) * (b[i] - b[j]) < 0)


@pytest.mark.parametrize("block_bits", [1, 2, 12])
def test_discordant_pairs_exact(spark, block_bits):
    rnd = random.Random(7)
    rows, expect = [], {}
    for g in range(6):
        n = rnd.randint(1, 40)
        a = list(range(1, n + 1))
        b = a[:]
        rnd.shuffle(b)
        expect[g] = _brute(a, b)
        rows += [(g, x, y) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "g int, a int, b int")
    got = {r["g"]: r["discordant"] for r in agreement.discordant_pairs(df, ["g"], block_bits=block_bits).collect()}
    assert got == expect


def test_pairwise_properties(spark):
    rnd = random.Random(3)
    cands = [f"c{i}" for i in range(9)]
    rankings = []
    for r in range(4):
        c = cands[:]
        rnd.shuffle(c)
        rankings.append((f"r{r}", c))
    p = agreement.pairwise(_ballots(spark, rankings)).collect()
    cell = {(r["entity_a"], r["entity_b"]): (r["hamming"], r["tau"]) for r in p}
    assert len(cell) == 16
    for (a, b), (h, t) in cell.items():
        assert cell[(b, a)] == (h, t)            # symmetric
        if a == b:
            assert h == 0 and t == 1.0           # diagonal
        assert -1.0 <= t <= 1.0 and h >= 0


def test_rank_mode_invariant_under_renaming(spark):
    a = [("a", ["x", "y", "z", "w"])]
    ref = [("ref", ["y", "x", "w", "z"])]
    ren = {"x": "q", "y": "b", "z": "m", "w": "a"}
    t1 = agreement.compare_to_reference(_ballots(spark, a), _ballots(spark, ref), "rank").first()["tau"]
    t2 = agreement.compare_to_reference(_ballots(spark, [("a", [ren[c] for c in a[0][1]])]),
                                        _ballots(spark, [("ref", [ren[c] for c in ref[0][1]])]), "rank").first()["tau"]
    assert t1 == pytest.approx(t2)
    l1 = agreement.compare_to_reference(_ballots(spark, a), _ballots(spark, ref), "label_sequence").first()["tau"]
    l2 = agreement.compare_to_reference(_ballots(spark, [("a", [ren[c] for c in a[0][1]])]),
                                        _ballots(spark, [("ref", [ren[c] for c in ref[0][1]])]),
                                        "label_sequence").first()["tau"]
    assert l1 != pytest.approx(l2)   # the code's definition depends on the names


def test_hamming_is_symmetric_difference(spark):
    b = _ballots(spark, [("a", ["p", "q", "r", "s"])])       # promising: p, q
    ref = _ballots(spark, [("ref", ["q", "s", "p", "r"])])   # promising: q, s
    assert agreement.compare_to_reference(b, ref).first()["hamming"] == 2


@pytest.mark.parametrize("p,a,b,want", [
    (0.1, ["dog", "cat", "mom"], ["dog", "cat", "mom"], 0.999),
    (0.1, ["apple", "peach", "mom"], ["dog", "cat", "dad"], 0.0),
    (0.1, ["dog", "cat", "mom"], ["dog", "cat", "dad"], 0.996),
    (0.6, ["dog", "cat", "mom"], ["dog", "cat", "dad"], 0.736),
    (0.6, ["dog", "cat", "mom", "tennis"], ["dog", "cat", "dad", "tennis"], 0.8008),
    (0.6, ["dog", "cat", "mom", "tennis"], ["dog", "cat", "dad", "golf"], 0.7792),
])
def test_rank_biased_overlap_examples(spark, p, a, b, want):
    from rankwise.operators.described import rank_biased_overlap
    got = rank_biased_overlap(_ballots(spark, [("a", a)]), _ballots(spark, [("ref", b)]), p).collect()
    assert (got[0]["rbo"] if got else 0.0) == pytest.approx(want, abs=1e-4)


def test_margins_are_told_from_null_labels(spark):
    cells = spark.createDataFrame([("j", None, "a", 1.0), ("j", None, None, 3.0), ("j", "a", "a", 5.0), ("j", "a", None, 7.0)],
                                  "job_id string, entity_a string, entity_b string, value double")
    got = {(r["entity_a"], r["entity_b"]): r["value"] for r in matrices.with_margins(cells).collect()}
    assert got == {(None, "a"): 1.0, (None, None): 3.0, ("a", "a"): 5.0, ("a", None): 7.0, (None, "mean"): 2.0,
                   ("a", "mean"): 6.0, ("mean", "a"): 3.0, ("mean", None): 5.0, ("mean", "mean"): 4.0}


def test_discordant_pairs_with_a_bound_of_the_group(spark):
    df = spark.createDataFrame([(None, 1, 3, 9), (None, 2, 1, 9), (None, 3, 2, 9), ("g", 1, 1, 1)], "g string, a int, b int, n int")
    for top in (None, "n"):
        got = {r["g"]: (r["n"], r["discordant"]) for r in agreement.discordant_pairs(df, ["g"], top=top).collect()}
        assert got == {None: (3, 2), "g": (1, 0)}


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_a_rank_is_emitted_once_a_digit(spark, monkeypatch, bits):
    """Digits of any width give the exact count, also around their edges, with ranks missing."""
    monkeypatch.setattr(agreement, "DIGIT_BITS", bits)
    b = [512, 1, 64, 65, 8, 9, 63, None, 513, 7, 4096]
    df = spark.createDataFrame([("x", i + 1, r) for i, r in enumerate(b)], "g string, a int, b int")
    ranks = [r for r in b if r is not None]
    want = sum(x > y for x, y in itertools.combinations(ranks, 2))
    got = {r[0]: tuple(r[1:]) for r in agreement.discordant_pairs(df, ["g"], block_bits=2).collect()}
    assert got == {"x": (len(ranks), want)}
