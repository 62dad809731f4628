"""Agreement between ballots: Hamming distance and Kendall's tau.

Kendall's tau without quadratic pairs
-------------------------------------
For complete rankings without ties ``tau = 1 - 4 D / (n (n - 1))`` where
``D`` is the number of discordant pairs.  ``discordant_pairs`` counts them
exactly without emitting candidate pairs: a pair ``(y, x)`` with
``a(y) < a(x)`` and ``b(y) > b(x)`` is charged to the highest digit ``L`` at
which ``b(y) - 1`` and ``b(x) - 1`` differ, in digits of ``DIGIT_BITS`` bits
(there ``y`` has the higher digit, and both share the higher digits).  For each
level ``L`` the rows are grouped by those higher digits and the count becomes
"higher digits seen before each row in ``a`` order" - a running sum per digit.
To keep every window partition bounded, ``a`` is cut into blocks of
``2**block_bits``: inside a block a window counts, across blocks a running sum
over per-block counts does.  Rows emitted: ``n * log2(n) / DIGIT_BITS``; largest window partition:
``max(2**block_bits, n / 2**block_bits)`` rows.

Two definitions (trap 1 in the survey):

* ``method="rank"`` (default, the documented statistic): each candidate's
  places in both ballots (join on candidate).
* ``method="label_sequence"``: the reference code's behaviour - both ballots
  listed in place order and the *names* correlated position by position,
  i.e. the alphabetical rank of the name at each place (join on place).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwise.operators.ranking import rank_within

#: Bits of a digit: a row is emitted once for each digit of its rank.
DIGIT_BITS = 3

BALLOT_COLS = ["job_id", "rater", "rater_ord", "candidate", "place", "promising"]


def discordant_pairs(df: DataFrame, by: Sequence[str], a: str = "a", b: str = "b",
                     block_bits: int = 12, top: str | None = None) -> DataFrame:
    """Exact count of discordant pairs per group: ``(by..., n, discordant)``.

    ``a`` and ``b`` must be distinct positive integers within a group
    (positions of the same element in two rankings).  ``top`` names a column
    that is the same for all rows of a group and no ``b`` of it exceeds (the
    size of the ranking); without it each group's highest ``b`` is joined.
    """
    by = list(by)
    if top is None:
        tops = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.max(b).alias("_top"))
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        df, top = df.join(tops, same).drop(*[f"_by_{c}" for c in by]), "_top"
    base = df.select(*by, F.col(a).cast("long").alias("_a"), (F.col(b).cast("long") - 1).alias("_b0"),
                     F.greatest(F.col(top).cast("long") - 1, F.lit(1).cast("long")).alias("_high"))
    levels = F.floor((F.length(F.bin("_high")) - 1) / DIGIT_BITS).cast("int")
    x = (base.withColumn("_L", F.explode(F.sequence(F.lit(0), levels))).drop("_high")
         .withColumn("_d", F.expr(f"shiftright(_b0, _L * {DIGIT_BITS}) & {2 ** DIGIT_BITS - 1}"))
         .withColumn("_p", F.expr(f"shiftright(_b0, (_L + 1) * {DIGIT_BITS})"))
         .withColumn("_blk", F.shiftright("_a", block_bits)))
    group, digits = [*by, "_L", "_p"], range(2 ** DIGIT_BITS)
    inner = Window.partitionBy(*group, "_blk").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    # of the rows before: how many have a digit above d, for the row's own d
    above = [F.coalesce(F.count_if(F.col("_d") > d).over(inner), F.lit(0)).alias(f"_above{d}") for d in digits[:-1]]
    x = x.select(*group, "_blk", "_d", *above)
    own = F.coalesce(*[F.when(F.col("_d") == d, F.col(f"_above{d}")) for d in digits[:-1]], F.lit(0))
    blocks = x.groupBy(*group, "_blk").agg(F.sum(own).alias("_within"), *[F.count_if(F.col("_d") == d).alias(f"_n{d}") for d in digits])
    across = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    higher = lambda d: functools.reduce(Column.__add__, [F.col(f"_n{e}") for e in digits[d + 1:]])
    cross = [F.col(f"_n{d}") * F.coalesce(F.sum(higher(d)).over(across), F.lit(0)) for d in digits[:-1]]
    blocks = blocks.select(*group, "_within", functools.reduce(Column.__add__, [F.col(f"_n{d}") for d in digits]).alias("_rows"),
                           functools.reduce(Column.__add__, cross).alias("_cross"))
    some = F.col("_rows") > 0  # rows without a rank count nowhere
    at_bottom = F.when((F.col("_L") == 0) & some, F.col("_rows"))  # every row once
    return blocks.groupBy(*by).agg(F.sum(at_bottom).cast("bigint").alias("n"),
                                   F.sum(F.when(some, F.col("_within") + F.col("_cross"))).cast("bigint").alias("discordant"))


def tau_from_discordant(n: Column, d: Column) -> Column:
    """tau-b for complete rankings without ties; null below two elements."""
    return F.when(n >= 2, F.lit(1.0) - F.lit(4.0) * d / (n * (n - 1)))


def _ballot_tops(ballots: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """``(job_id, top)``: what no place and no rank of a name on a ballot of the job exceeds."""
    per = ballots.groupBy("job_id", *entity).agg(F.max("place").cast("long").alias("_p"), F.count(F.lit(1)).alias("_n"))
    high = F.greatest("_p", "_n")
    return per.groupBy("job_id").agg(F.max(high).alias("top")) if entity else per.select("job_id", high.alias("top"))


def _pair_positions(left: DataFrame, right: DataFrame, method: str, pair_keys: Sequence[str]) -> DataFrame:
    """Rows ``(job_id, <pair keys>, a, b, top)`` for one comparison per pair of ballots."""
    if method == "rank":
        j = left.join(right, ["job_id", "candidate"])
        return j.select("job_id", *pair_keys, F.col("place_l").alias("a"), F.col("place_r").alias("b"), "top")
    if method == "label_sequence":
        j = left.join(right, ["job_id", "place"])
        return j.select("job_id", *pair_keys, F.col("lex_l").alias("a"), F.col("lex_r").alias("b"), "top")
    raise ValueError(f"unknown tau method {method!r}")


def with_label_rank(ballots: DataFrame, entity: str = "rater") -> DataFrame:
    """Alphabetical (code point) rank of each name inside its ballot."""
    return rank_within(ballots, ["job_id", entity], ["candidate"], name="lex")


def compare_to_reference(ballots: DataFrame, reference: DataFrame, method: str = "rank") -> DataFrame:
    """J4/J5 + A8 + A9: each ballot of a job against the job's reference ballot.

    Output ``(job_id, rater, hamming, tau, n)``.  Linear in the number of
    ballots: the reference side has one ballot per job.
    """
    left = ballots.select("job_id", "rater", "candidate", F.col("place").alias("place_l"),
                          F.col("promising").alias("prom_l"))
    right = reference.select("job_id", "candidate", F.col("place").alias("place_r"),
                             F.col("promising").alias("prom_r"))
    if method == "label_sequence":
        # one ranking pass over both sides (the reference tagged as its own ballot)
        both = (ballots.select("job_id", F.col("rater").alias("_who"), "candidate", "place")
                .unionByName(reference.select("job_id", F.lit("\u0000ref").alias("_who"), "candidate", "place")))
        lexed = with_label_rank(both, entity="_who")
        left = lexed.filter(F.col("_who") != "\u0000ref").select(
            "job_id", F.col("_who").alias("rater"), "place", F.col("lex").alias("lex_l"))
        right = lexed.filter(F.col("_who") == "\u0000ref").select("job_id", "place", F.col("lex").alias("lex_r"))
    pos = _pair_positions(left, right.join(_ballot_tops(reference), "job_id"), method, ["rater"])
    tau = discordant_pairs(pos, ["job_id", "rater"], top="top").withColumn(
        "tau", tau_from_discordant(F.col("n"), F.col("discordant")))
    ham = hamming_to_reference(ballots, reference)
    return ham.join(tau.select("job_id", "rater", "tau", "n"), ["job_id", "rater"], "left")


def hamming_to_reference(ballots: DataFrame, reference: DataFrame) -> DataFrame:
    """|P_a| + |P_ref| - 2 |P_a and P_ref| per ballot, from promising rows only."""
    pa = ballots.filter("promising").select("job_id", "rater", "candidate")
    pr = reference.filter("promising").select("job_id", "candidate")
    size_a = ballots.groupBy("job_id", "rater").agg(F.count_if("promising").alias("_sa"))
    size_r = reference.groupBy("job_id").agg(F.count_if("promising").alias("_sr"))
    both = pa.join(pr, ["job_id", "candidate"]).groupBy("job_id", "rater").agg(F.count(F.lit(1)).alias("_both"))
    return (size_a.join(size_r, "job_id", "left").join(both, ["job_id", "rater"], "left")
            .select("job_id", "rater", (F.coalesce("_sa", F.lit(0)) + F.coalesce("_sr", F.lit(0))
                                        - 2 * F.coalesce("_both", F.lit(0))).cast("bigint").alias("hamming")))


def pairwise(ballots: DataFrame, method: str = "rank") -> DataFrame:
    """J7 + A20: every entity against every entity of the same job, both
    directions and the diagonal: ``(job_id, entity_a, entity_b, hamming, tau)``.

    The result is m x m per job by definition (m = entities); pairs are
    computed once for ``ord_a < ord_b`` and mirrored, the diagonal is known
    (distance 0, tau 1).  The join is on ``(job_id, candidate)`` so work is
    spread over candidates rather than gathered per job.
    """
    b = ballots.select("job_id", F.col("rater").alias("entity"), F.col("rater_ord").alias("ord"),
                       "candidate", "place", "promising")
    if method == "label_sequence":
        lexed = with_label_rank(b, entity="entity")
        left = lexed.select("job_id", F.col("entity").alias("entity_a"), F.col("ord").alias("ord_a"),
                            "place", F.col("lex").alias("lex_l"))
        right = lexed.select("job_id", F.col("entity").alias("entity_b"), F.col("ord").alias("ord_b"),
                             "place", F.col("lex").alias("lex_r"))
    else:
        left = b.select("job_id", F.col("entity").alias("entity_a"), F.col("ord").alias("ord_a"), "candidate",
                        F.col("place").alias("place_l"))
        right = b.select("job_id", F.col("entity").alias("entity_b"), F.col("ord").alias("ord_b"), "candidate",
                         F.col("place").alias("place_r"))
    key = "place" if method == "label_sequence" else "candidate"
    right = right.join(_ballot_tops(b, ["entity"]), "job_id")
    j = left.join(right, ["job_id", key]).filter(F.col("ord_a") < F.col("ord_b"))
    pos = j.select("job_id", "entity_a", "entity_b",
                   F.col("lex_l" if method == "label_sequence" else "place_l").alias("a"),
                   F.col("lex_r" if method == "label_sequence" else "place_r").alias("b"), "top")
    tau = discordant_pairs(pos, ["job_id", "entity_a", "entity_b"], top="top").withColumn(
        "tau", tau_from_discordant(F.col("n"), F.col("discordant")))
    # Hamming from promising rows only
    p = b.filter("promising")
    pl = p.select("job_id", F.col("entity").alias("entity_a"), F.col("ord").alias("ord_a"), "candidate")
    pr = p.select("job_id", F.col("entity").alias("entity_b"), F.col("ord").alias("ord_b"), "candidate")
    both = (pl.join(pr, ["job_id", "candidate"]).filter(F.col("ord_a") < F.col("ord_b"))
            .groupBy("job_id", "entity_a", "entity_b").agg(F.count(F.lit(1)).alias("_both")))
    sizes = b.groupBy("job_id", "entity").agg(F.min("ord").alias("_o"), F.count_if("promising").alias("_k"),
                                              F.count(F.lit(1)).alias("_n"))
    sa = sizes.select("job_id", F.col("entity").alias("entity_a"), F.col("_k").alias("_ka"), F.col("_o").alias("_oa"))
    sb = sizes.select("job_id", F.col("entity").alias("entity_b"), F.col("_k").alias("_kb"), F.col("_o").alias("_ob"))
    # the m x m grid first: two entities without a common candidate have a cell too (no tau, n = 0)
    grid = sa.join(sb, "job_id").filter(F.col("_oa") < F.col("_ob"))
    upper = (grid.join(tau, ["job_id", "entity_a", "entity_b"], "left").join(both, ["job_id", "entity_a", "entity_b"], "left")
             .select("job_id", "entity_a", "entity_b",
                     (F.col("_ka") + F.col("_kb") - 2 * F.coalesce("_both", F.lit(0))).cast("bigint").alias("hamming"),
                     "tau", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    mirror = upper.select("job_id", F.col("entity_b").alias("entity_a"), F.col("entity_a").alias("entity_b"),
                          "hamming", "tau", "n")
    diag = sizes.select("job_id", F.col("entity").alias("entity_a"), F.col("entity").alias("entity_b"),
                        F.lit(0).cast("bigint").alias("hamming"),
                        tau_from_discordant(F.col("_n"), F.lit(0)).alias("tau"), F.col("_n").alias("n"))
    return upper.unionByName(mirror).unionByName(diag)


def pairwise_metric(ballots: DataFrame, metric: Column, name: str = "value") -> DataFrame:
    """Any pair metric.  ``metric`` is an aggregate over the candidates that both ballots rank, in terms of
    ``place_a``, ``place_b``, ``promising_a`` and ``promising_b``; cells ``(job_id, entity_a, entity_b, name)`` for
    every ordered pair with a common candidate, the diagonal included."""
    side = lambda x: ballots.select("job_id", "candidate", F.col("rater").alias(f"entity_{x}"),
                                    F.col("place").alias(f"place_{x}"), F.col("promising").alias(f"promising_{x}"))
    return (side("a").join(side("b"), ["job_id", "candidate"]).groupBy("job_id", "entity_a", "entity_b")
            .agg(metric.alias(name)))
