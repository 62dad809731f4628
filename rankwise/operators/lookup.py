"""Unique lookups (P9) and positional display names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_lookup(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """``unique_match`` is true when the value names exactly one key and
    the key has exactly one value (two aggregates joined back)."""
    pairs = pairs.select(key, value).distinct()
    per_v = pairs.groupBy(value).agg(F.count(F.lit(1)).alias("_nv"))
    per_k = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_nk"))
    return (pairs.join(per_v, value).join(per_k, key)
            .select(key, value, ((F.col("_nv") == 1) & (F.col("_nk") == 1)).alias("unique_match")))


def candidate_names(layout: list[dict], spark) -> DataFrame:
    """``(job_id, candidate_no, name)`` from the ballot header positions
    (candidate ``j`` of a job is the ``j``-th place column of its block).
    Built once from schema metadata; a small dimension (broadcast)."""
    from rankwise.functions.columns import label_suffix
    rows = [(blk["job_id"], i + 1, label) for blk in layout for i, (_, label) in enumerate(blk["places"])]
    df = spark.createDataFrame(rows, "job_id string, candidate_no int, label string")
    return df.select("job_id", "candidate_no", label_suffix(F.col("label")).alias("name"))
