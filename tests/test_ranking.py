"""Numbering and running counts against windows, with null keys, ties, hot groups and odd values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwise.operators import ranking
from rankwise.operators.ranking import desc, prefix_count, rank_within

NAN, INF = float("nan"), float("inf")


def _rows():
    r = random.Random(7)
    out = []
    for i in range(1500):
        g = r.choice(["hot"] * 6 + ["a", "b", None])
        out.append((g, r.choice([None, 1, 2]), r.choice([None, NAN, INF, -INF, -0.0, 0.0, 1e300, -1e300, r.random(), r.random() * 50]),
                    r.choice([None, True, False]), r.choice([None, "", "aaaaaaaa", "aaaaaab", "é", "z", str(r.random())]), i,
                    r.choice([None, 2**62, 2**62 + 1, -(2**62), 5])))
    return out


def _orders():
    return [["v", "id"], [desc("v"), "id"], ["s", desc("id")], [desc("s"), "id"], ["f", desc("v"), "id"], [desc("f"), "h", "s", "id"],
            [desc("h"), "n", "v", "id"], ["n", "f", "h", "id"], [desc("id")], [F.col("id") % 7, "id"], [F.struct("f", "s"), "id"]]


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []], ids=str)
@pytest.mark.parametrize("k", range(11))
def test_equal_to_a_window(spark, by, k, monkeypatch):
    monkeypatch.setattr(ranking, "SAMPLE", 1024 if k == 0 else 4)
    df = spark.createDataFrame(_rows(), "g string, h int, v double, f boolean, s string, id long, n long")
    order = _orders()[k]
    keys = [x.expr.desc() if isinstance(x, ranking.Key) else (F.col(x) if isinstance(x, str) else x).asc() for x in order]
    w = Window.partitionBy(*by).orderBy(*keys)
    flag = F.col("id") % 3 == 0
    want = df.select("id", F.row_number().over(w).cast("bigint").alias("place"),
                     F.coalesce(F.sum(flag.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c"))
    got = prefix_count(rank_within(df, by, order), by, order, flag, "c").select("id", "place", "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "g string, id long")
    assert rank_within(df, ["g"], ["id"]).collect() == [] and rank_within(df, [], ["id"]).collect() == []
    one = spark.createDataFrame([(None, None)], "g string, id long")
    assert [r["place"] for r in rank_within(one, ["g"], ["id"]).collect()] == [1]


def test_place_is_bigint_and_nothing_is_collected(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 5003).alias("v"), "id")
    out = rank_within(df, ["g"], [desc("v"), "id"])
    assert dict(out.dtypes)["place"] == "bigint" and out.columns == ["g", "v", "id", "place"]


def _largest(df, by, order):
    rows, groups, cells = ranking._in_cells(df, by, order)
    return rows.groupBy(*groups, *cells).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("kind", ["spread", "tied", "outlier", "text", "two groups"])
def test_cells_are_even(spark, monkeypatch, kind):
    """A hot group's rows are spread whatever the order key looks like; no cell holds 5 % of them."""
    monkeypatch.setattr(ranking, "SAMPLE", 8)
    v = {"spread": F.col("id") * 7919 % 5003, "tied": F.lit(1).cast("bigint"), "text": F.concat(F.lit("https://www.example.org/"), F.col("id")),
         "outlier": F.when(F.col("id") % 4000 == 7, F.lit(10**12)).otherwise(F.col("id") % 97)}.get(kind, F.col("id"))
    df = spark.range(20_000).select((F.col("id") % 3 == 0 if kind == "two groups" else F.lit("hot")).alias("g"), v.alias("v"), "id")
    assert _largest(df, ["g"], [ranking.desc("v"), ranking.asc("id")]) <= 1000
    got = rank_within(df, ["g"], [desc("v"), "id"])
    want = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id"))
    assert got.withColumn("want", want).where("place <> want").count() == 0


def test_many_bounds_are_thinned(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SAMPLE", 1)
    monkeypatch.setattr(ranking, "PART_KEYS", 16)
    monkeypatch.setattr(ranking, "MOST", 63)
    df = spark.range(9000).select(F.lit(1).alias("g"), "id")
    bounds = ranking._bounds(df.withColumn("_rk_o0", F.col("id")), ["g"], [ranking.asc("id")]).first()._rk_bounds
    assert len(bounds) == 63 and bounds == sorted(bounds)
    assert _largest(df, ["g"], [ranking.asc("id")]) <= 450


def test_lineitem_with_outliers(spark):
    """Three hot groups of ``lineitem``, a few rows of which cost 10^12: no task above a twentieth of the rows."""
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    cost = F.when(F.pmod(F.xxhash64("l_orderkey", "l_partkey"), F.lit(50_000)) == 0, F.lit(1e12)).otherwise(F.col("l_extendedprice").cast("double"))
    df = li.select("l_returnflag", cost.alias("cost"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    assert df.agg(F.max("cost")).first()[0] == 1e12
    keys = [ranking.desc("cost"), *[ranking.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]]
    assert _largest(df, ["l_returnflag"], keys) <= 0.05 * df.count()


def test_a_row_meets_few_bounds_however_large_its_group(spark, monkeypatch):
    """Bounds of a group stay as few while its cells are small enough for a task, and grow with it after that."""
    monkeypatch.setattr(ranking, "SAMPLE", 1)
    monkeypatch.setattr(ranking, "FULL_CELL", 50)
    for n, want in ((400, 50), (3000, ranking.FEW), (20_000, 400)):
        df = spark.range(n).select(F.lit(1).alias("g"), "id", F.col("id").alias("_rk_o0"))
        assert len(ranking._bounds(df, ["g"], [ranking.asc("id")]).first()._rk_bounds) == want


def test_rows_move_once_for_each_order(spark, monkeypatch):
    """Bounds and sums come to the rows, which move to their cells and nowhere else; groups beyond the largest stay whole."""
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("v"), "id")
    out = prefix_count(rank_within(df, ["g"], [desc("v"), "id"]), ["g"], ["v", "id"], F.col("id") % 2 == 0, "c")
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = plan[:plan.index("Range (")]  # a node's first child follows it, so these are the nodes that the rows go through
    assert rows.count("Exchange") == 2 and "SortMergeJoin" not in rows
    monkeypatch.setattr(ranking, "SAMPLE", 1)
    monkeypatch.setattr(ranking, "GROUPS", 2)
    many = df.withColumn("g", F.when(F.col("id") < 2000, 1).when(F.col("id") < 3500, 5).otherwise(F.col("id") % 4))
    cut = ranking._in_cells(many, ["g"], [desc("v"), ranking.asc("id")])[0].groupBy("g").agg(F.max("_rk_cell").alias("c")).collect()
    assert {r.g for r in cut if r.c > 0} == {1, 5}
    got = rank_within(many, ["g"], [desc("v"), "id"])
    want = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id"))
    assert got.withColumn("want", want).where("place <> want").count() == 0
