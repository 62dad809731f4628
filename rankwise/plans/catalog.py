"""All registered queries (imports register them) and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankwise.plans import q_chat, q_described, q_evaluation, q_files, q_front, q_scoring, q_sources, q_streaming, q_text  # noqa: F401
from rankwise.plans.registry import REGISTRY, Builder


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY["job_metrics_label_sequence"][0](spark, sf_dir)
