"""Agreement matrices, mean matrix, margins and time tables (long form).

A matrix is stored long: ``(job_id, entity_a, entity_b, value)``; the wide
display form is a ``pivot`` at the sink.  Margins are grouping sets with
the label ``mean`` for the aggregated side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwise.functions.columns import tau_to_pair_distance
from rankwise.schemas import MEAN_LABEL


def with_margins(cells: DataFrame, value: str = "value", key: str = "job_id") -> DataFrame:
    """Add a mean column (per row entity), a mean row (per column entity)
    and the corner (mean of all cells) - ``GROUPING SETS`` over the long form.

    Equal to the reference's means-of-means only on complete matrices (P7).
    """
    g = cells.groupingSets([[key, "entity_a", "entity_b"], [key, "entity_a"], [key, "entity_b"], [key]],
                           key, "entity_a", "entity_b")
    out = g.agg(F.avg(value).alias(value), F.grouping_id().alias("_gid"))
    return out.select(key, _label("entity_a", 2), _label("entity_b", 1), value)


def _label(column: str, bit: int) -> Column:
    """A grouping column, or the label where it is aggregated (``bit`` of ``_gid``); a null of the data stays null."""
    return F.when(F.col("_gid").bitwiseAND(bit) > 0, F.lit(MEAN_LABEL)).otherwise(F.col(column)).alias(column)


def entity_sets(cells: DataFrame) -> DataFrame:
    """Per job the sorted entity list (bounded: entities are raters)."""
    return cells.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_set("entity_a")), "|").alias("entities"))


def shape_report(cells: DataFrame) -> DataFrame:
    """``(entities, n_jobs)`` per distinct entity set; one row = all job
    matrices share their shape (required before A18)."""
    return (entity_sets(cells).groupBy("entities")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_jobs")))


def mean_matrix(cells: DataFrame, value: str = "value") -> DataFrame:
    """Cell-wise mean over jobs, labelled ``job_id = 'mean'``.

    P7 is enforced: the query fails if some cell is missing in some job's
    matrix (checked over the m x m cells of the result)."""
    per = cells.groupBy("entity_a", "entity_b").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_jobs"))
    every = F.max("_jobs").over(Window.partitionBy())
    same = F.assert_true(F.col("_jobs") == every, F.lit("the job matrices differ in shape"))
    return (per.withColumn(value, F.when(same.isNull(), F.col(value)))
            .select(F.lit(MEAN_LABEL).alias("job_id"), "entity_a", "entity_b", value))


def matrix_cells(pairs: DataFrame, metric: str, include_model: bool = True,
                 model_entity: str = "model") -> DataFrame:
    """One metric of the pairwise table as matrix cells (``value`` double)."""
    df = pairs if include_model else pairs.filter((F.col("entity_a") != model_entity)
                                                  & (F.col("entity_b") != model_entity))
    return df.select("job_id", "entity_a", "entity_b", F.col(metric).cast("double").alias("value"))


def transform_cells(cells: DataFrame, transform: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """The matrix with ``transform`` applied to every cell."""
    return cells.withColumn(value, transform(F.col(value)))


def tau_distance_cells(tau_cells: DataFrame, ballot_size: DataFrame) -> DataFrame:
    """X5 + E3: tau -> number of discordant pairs, floor with a 1e-9 guard."""
    return transform_cells(tau_cells.join(ballot_size, "job_id"),
                           lambda tau: tau_to_pair_distance(tau, F.col("n")).cast("double")).drop("n")


def time_table(headers: DataFrame) -> DataFrame:
    """Job x rater minutes with a mean column (per job) and a mean row
    (per rater) and the corner, long form ``(job_id, rater, minutes)``."""
    g = headers.groupingSets([["job_id", "rater"], ["job_id"], ["rater"], []], "job_id", "rater")
    out = g.agg(F.avg("minutes").alias("minutes"), F.grouping_id().alias("_gid"))
    return out.select(_label("job_id", 2), _label("rater", 1), "minutes")


def model_time_table(run_info: DataFrame) -> DataFrame:
    """A19 (model): minutes = seconds / 60 per job plus a mean row."""
    m = run_info.select("job_id", (F.col("seconds_taken") / 60.0).alias("minutes"))
    g = m.groupingSets([["job_id"], []], "job_id")
    return g.agg(F.avg("minutes").alias("minutes"), F.grouping_id().alias("_gid")).select(_label("job_id", 1), "minutes")


def wide(cells: DataFrame, value: str = "value") -> DataFrame:
    """Display form: one row per (job, entity_a), one column per entity_b."""
    ents = [r[0] for r in cells.select("entity_b").distinct().orderBy("entity_b").collect()]
    return cells.groupBy("job_id", "entity_a").pivot("entity_b", ents).agg(F.first(value))
