"""Connected components of a link table, by alternating star contraction.

Links stay in Spark from start to end; only the number of changed links of
a round reaches the driver.  Each round is two aggregations and two joins
over the links; the star of a node is never gathered, its smallest
neighbour is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected links ``(u, v)``, ``u > v``."""
    if large:
        around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("m", "u"))
    both = around.join(least, "u")
    if large:  # larger neighbours hang on the smallest one
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hung = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links of bigint nodes -> ``(node, component)``.

    ``component`` is the smallest node that links reach.  Direction,
    repeats and self links don't matter; links with a null end are left
    out; nodes without a link are absent (they are their own component).
    """
    pairs = stored(links.where("a is not null and b is not null and a <> b")
                   .select(F.greatest("a", "b").cast("bigint").alias("u"),
                           F.least("a", "b").cast("bigint").alias("v")).distinct())
    seen = None
    while True:
        pairs = stored(_star(_star(pairs, True), False))
        mark = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return roots.union(pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))).distinct()
