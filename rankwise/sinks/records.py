"""Sinks: nested records and partitioned writers.

Working tables stay long; nesting happens here, once, per output row.
Writers partition by ``job_id`` (never one file per candidate) and write
to a new location; nothing is collected to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A file of a sink holds so many rows at most.
ROWS_PER_FILE = 1_000_000


def match_records(scores: DataFrame, decided: DataFrame) -> DataFrame:
    """X16 + S9: ``(job_id, candidate_id, record)`` where ``record`` is the
    JSON of ``{total_score, promising_result, requirement_matches: {type:
    [{score: {value, explanation}, requirement: {type, specification}}]}}``.

    Gathering is per (candidate, type) and then per candidate: bounded by
    the number of requirements of one job.
    """
    item = F.struct(F.struct(F.col("score").alias("value"), F.col("explanation")).alias("score"),
                    F.struct(F.col("kind").alias("type"), F.col("specification")).alias("requirement"))
    per_type = (scores.groupBy("job_id", "candidate_id", "type")
                .agg(F.array_sort(F.collect_list(F.struct(F.col("requirement_id").alias("_k"), item.alias("m"))))
                     .alias("_l"))
                .select("job_id", "candidate_id", "type", F.transform("_l", lambda x: x["m"]).alias("matches")))
    per_cand = per_type.groupBy("job_id", "candidate_id").agg(
        F.map_from_entries(F.collect_list(F.struct("type", "matches"))).alias("requirement_matches"))
    rec = decided.join(per_cand, ["job_id", "candidate_id"], "left")
    explanation = F.when(F.col("promising"), F.lit("total and mandatory requirements above the thresholds")) \
        .otherwise(F.lit("total or a mandatory requirement below its threshold"))
    return rec.select("job_id", "candidate_id", F.to_json(F.struct(
        F.col("total_score"),
        F.struct(F.col("promising"), explanation.alias("explanation")).alias("promising_result"),
        F.col("requirement_matches"))).alias("record"))


def write_overview(overview: DataFrame, path: str, decimals: int = 2) -> None:
    """A folder of CSV files per job, doubles rounded, place kept.  Rows are dealt by (job, place), so a
    large job is written by many tasks."""
    cols = [F.round(c, decimals).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in overview.dtypes]
    (overview.select(*cols).repartitionByRange("job_id", "place").sortWithinPartitions("job_id", "place")
     .write.mode("overwrite").partitionBy("job_id").option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path))


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, one record per candidate, partitioned by job."""
    (records.repartitionByRange("job_id", "candidate_id").write.mode("overwrite").partitionBy("job_id")
     .option("maxRecordsPerFile", ROWS_PER_FILE).json(path))


def write_matrices(cells: DataFrame, path: str, metric: str) -> None:
    """Long matrix cells partitioned by metric and job; the mean matrix
    (``job_id = 'mean'``) keeps 3 decimals, the others 2."""
    out = cells.withColumn("metric", F.lit(metric)).withColumn(
        "value", F.when(F.col("job_id") == "mean", F.round("value", 3)).otherwise(F.round("value", 2)))
    out.repartitionByRange("job_id", F.xxhash64(*out.columns)).write.mode("overwrite").partitionBy("metric", "job_id") \
        .option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)


def report(per_job: DataFrame, overall: DataFrame) -> DataFrame:
    """The evaluation report as JSON lines - one record per job and one
    ``overall`` record (``scope``, ``job_id``, ``metrics``); nothing is
    gathered into a single row or task."""
    jobs = per_job.select(F.lit("job").alias("scope"), F.col("job_id").cast("string").alias("job_id"),
                          F.to_json(F.struct(*[c for c in per_job.columns if c != "job_id"])).alias("metrics"))
    ov = overall.select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("job_id"),
                        F.to_json(F.struct(*overall.columns)).alias("metrics"))
    return jobs.unionByName(ov)


def write_report(per_job: DataFrame, overall: DataFrame, path: str) -> None:
    report(per_job, overall).write.mode("overwrite").json(path)


def write_run_info(timings: DataFrame, path: str) -> None:
    """Run info of each job as JSON lines."""
    run_info(timings).write.mode("overwrite").json(path)


def run_info(timings: DataFrame) -> DataFrame:
    """``{"seconds_taken": ceil}`` per job from the paired timers."""
    return timings.groupBy("job_id").agg(F.ceil(F.sum("seconds")).cast("bigint").alias("seconds_taken"))


def combined_response(overview: DataFrame, records: DataFrame) -> DataFrame:
    """The overview rows of each request with their records, a row per (job, candidate); nothing is gathered
    per job."""
    return overview.join(records.select("job_id", "candidate_id", "record"), ["job_id", "candidate_id"], "left")


# ------------------------------------------------------------------ named files

def write_files(contents: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> None:
    """A file of its own for each row: ``root/<path>`` with the row's bytes or text (null: an empty file).

    Spark's writers name their files themselves; a document tree (S1), a
    configuration (S7) or a result folder of other programs (S6) needs given
    names.  The tasks write, to a name of their own that no scan reads, and
    move the file to its place when it is whole: a task that runs again, or
    twice, leaves the same files.  Rows of equal path overwrite each other.
    """
    rows = contents.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content"))

    def write(batches):
        import pyarrow as pa
        store, base = _file_system(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{base}/{path}"
                folder, name = place.rsplit("/", 1)
                store.create_dir(folder, recursive=True)
                part = f"{folder}/_{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def _file_system(root: str):
    """Arrow's file system for a folder as Spark names it, and the folder's path on it."""
    from urllib.parse import urlparse

    from pyarrow import fs
    at = urlparse(root)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), at.path.rstrip("/")
    return fs.FileSystem.from_uri(root.rstrip("/"))


def write_ballot_csv(wide: DataFrame, layout: list[dict], path: str, ts_col: str, order_col: str) -> None:
    """The questionnaire file that S5 reads: time stamp, then a block per job, in the order of ``order_col``.

    Labels repeat from block to block, which Spark's CSV writer refuses, so
    lines are made by ``to_csv`` and written as text.  One file by nature: a
    line per rater of one questionnaire.
    """
    cols, labels = [ts_col], ["Timestamp"]
    for blk in layout:
        cols += [blk["minutes"], blk["promising"], *[c for c, _ in blk["places"]]]
        labels += ["Minutes for this job?", "Promising candidates?", *[label for _, label in blk["places"]]]
    quoting = {"escape": '"', "nullValue": ""}
    line = lambda values: F.to_csv(F.struct(*[v.cast("string").alias(f"c{i}") for i, v in enumerate(values)]), quoting)
    body = wide.select(F.lit(1).alias("k"), F.col(f"`{order_col}`").alias("t"), line([F.col(f"`{c}`") for c in cols]).alias("value"))
    head = wide.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(None).cast(dict(wide.dtypes)[order_col]).alias("t"),
                                             line([F.lit(x) for x in labels]).alias("value"))
    body.unionByName(head).repartition(1).sortWithinPartitions("k", "t", "value") \
        .select("value").write.mode("overwrite").text(path)
