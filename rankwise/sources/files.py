"""File sources: candidate documents (S1-S4, P6), the wide ballot CSV (S5),
model result tables and run info (S6), the requirement-type config (S7).

Paths are parsed with expressions on the ``path`` column.  A scan with
contents reads only files whose names can be candidate or job documents of a
supported suffix (``pathGlobFilter``), in the job folders that are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwise.operators.ballots import BLOCK, csv_layout, rater_ids, unpivot_wide
from rankwise.operators.ranking import desc, rank_within

# Document suffixes in priority order (pdf before docx before txt).
DOCUMENT_SUFFIXES = ["pdf", "docx", "txt"]
#: A scan with so many partitions for each core or more shares them out among this many tasks a core.
SCAN_TASKS_PER_CORE = 32

_JOB_RE = r"job_(\d+)/"
_FOLDER_RE = r"^(.*job_\d+)/"
_CAND_RE = r"candidate_([^/]+)\.([A-Za-z0-9]+)$"
_JOBDOC_RE = r"job_(\d+)/job_description\.([A-Za-z0-9]+)$"


def parse_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``job_no``, ``job_folder``, ``candidate_name``, ``candidate_no`` (null
    unless the name is a number), ``suffix``, ``kind`` (candidate /
    job_description / other) from the path text."""
    p = F.col(path_col)
    cand = F.regexp_extract(p, _CAND_RE, 1)
    jobdoc = F.regexp_extract(p, _JOBDOC_RE, 2)
    suffix = F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    return paths.select("*",
                        F.regexp_extract(p, _JOB_RE, 1).try_cast("int").alias("job_no"),
                        F.regexp_extract(p, _FOLDER_RE, 1).alias("job_folder"),
                        F.when(cand != "", cand).alias("candidate_name"),
                        F.when(cand.rlike(r"^\d+$"), cand.try_cast("bigint")).alias("candidate_no"),
                        suffix.alias("suffix"),
                        F.when(cand != "", F.lit("candidate")).when(jobdoc != "", F.lit("job_description"))
                        .otherwise(F.lit("other")).alias("kind"))


def candidate_documents(parsed: DataFrame) -> DataFrame:
    """Candidate files with a supported suffix."""
    return parsed.filter((F.col("kind") == "candidate") & F.col("suffix").isin(DOCUMENT_SUFFIXES))


def select_paths(parsed: DataFrame, jobs: Sequence[int] = (), candidates: Sequence[int] = (),
                 match: str = "exact", path_col: str = "path") -> DataFrame:
    """Keep documents of the requested jobs / candidates (empty = all).

    ``match="exact"`` compares the parsed numbers; ``match="substring"``
    reproduces the reference (``job_1`` also selects ``job_10``)."""
    out = parsed
    if match == "exact":
        if jobs:
            out = out.filter(F.col("job_no").isin(list(jobs)))
        if candidates:
            out = out.filter(F.col("candidate_no").isin(list(candidates)))
    elif match == "substring":
        if jobs:
            cond = F.lit(False)
            for j in jobs:
                cond = cond | F.col(path_col).contains(f"job_{j}")
            out = out.filter(cond)
        if candidates:
            cond = F.lit(False)
            for c in candidates:
                cond = cond | F.col(path_col).contains(f"candidate_{c}")
            out = out.filter(cond)
    else:
        raise ValueError(match)
    return out


def resolve_job_documents(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: per job folder (two trees may have a job of the same number) the
    job description with the best suffix (pdf, docx, txt); folders with
    candidates but no description go to ``missing``."""
    prio = F.array_position(F.array(*[F.lit(s) for s in DOCUMENT_SUFFIXES]), F.col("suffix"))
    docs = parsed.filter((F.col("kind") == "job_description") & (prio > 0)).withColumn("_prio", prio)
    best = (docs.groupBy("job_no", "job_folder")
            .agg(F.min(F.struct("_prio", "path", "suffix")).alias("b"))
            .select("job_no", "job_folder", F.col("b.path").alias("job_path"), F.col("b.suffix").alias("suffix")))
    cand_jobs = candidate_documents(parsed).select("job_no", "job_folder").distinct()
    missing = (cand_jobs.join(best.select("job_no", "job_folder"), ["job_no", "job_folder"], "left_anti")
               .withColumn("reason", F.lit("no_job_description")))
    return best, missing


def workloads(job_docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate documents grouped under their job (an equi join, ids and
    paths only - contents are read after selection)."""
    return (candidates.select("job_no", "job_folder", "candidate_no", F.col("path").alias("candidate_path"))
            .join(job_docs.select("job_folder", "job_path"), "job_folder").drop("job_folder"))


def workload_checks(job_docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per job folder exactly one job document and at least one candidate."""
    key = ["job_no", "job_folder"]
    j = job_docs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_job_docs"))
    c = candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("n_candidates"))
    out = j.join(c, key, "full").na.fill(0, ["n_job_docs", "n_candidates"])
    return out.withColumn("valid", (F.col("n_job_docs") == 1) & (F.col("n_candidates") >= 1))


def scan_documents(spark: SparkSession, root: str, with_content: bool = True, jobs: Sequence[int] = ()) -> DataFrame:
    """S1 on real files: recursive ``binaryFile`` scan of ``candidate_*`` and
    ``job_description.*`` files; text documents decoded as UTF-8.

    ``jobs`` restricts the scan to the folders ``job_<n>`` below ``root``.
    Files without a byte are not seen: Spark's file sources pass over them.
    Spark counts 4 MB for opening a file, so that a partition of small files
    holds some 30 of them; a task takes many such partitions, one after the
    other, so that the number of tasks does not grow with the files."""
    names = "{candidate_*,job_description}.{%s}" % ",".join(x for s in DOCUMENT_SUFFIXES for x in (s, s.upper()))
    paths = [f"{root.rstrip('/')}/job_{j}" for j in jobs] or [root]
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(paths)
          .select("path", "length", *(["content"] if with_content else []))
          .coalesce(SCAN_TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    parsed = parse_paths(df)
    if with_content:
        parsed = parsed.withColumn("text", F.when(F.col("suffix") == "txt", F.decode("content", "UTF-8")))
    return parsed


# ------------------------------------------------------------------ ballots CSV

def read_ballot_csv(spark: SparkSession, path: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """S5 + W2: the wide questionnaire CSV -> (ballots, headers).

    Repeated header texts get their position appended on read, so blocks
    are found by position; the candidate labels are taken from the header
    line itself (schema metadata, one line).  Rater id = row index in the
    file, from the time stamp order (the form writes rows in submission
    order)."""
    import csv as _csv
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cols = raw.columns
    header_line = spark.read.text(path).first()[0]
    labels = next(_csv.reader([header_line]))
    ordered = rater_ids(raw, cols[0])
    layout = csv_layout(cols, block)
    by_pos = dict(zip(cols, labels))
    for blk in layout:
        blk["places"] = [(c, by_pos.get(c, c)) for c, _ in blk["places"]]
    return unpivot_wide(ordered, layout, ts_col=cols[0])


# ------------------------------------------------------------ model results

def read_model_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """S6 + P10: every job's ranked result table and run info in one scan
    each; ``job_no`` from the path.  ``place`` is the file's column, or else
    the position by (promising desc, total desc, candidate); the position of
    a row in the file is not used."""
    res = (spark.read.option("header", True).option("inferSchema", False)
           .csv(f"{root}/job_*/result/job_match_result.csv")
           .withColumn("job_no", F.regexp_extract(F.input_file_name(), _JOB_RE, 1).try_cast("int")))
    res = res.select("job_no", "candidate", F.col("promising").try_cast("boolean").alias("promising"),
                     F.col("total_score").try_cast("double").alias("total_score"),
                     *([F.col("place").try_cast("bigint").alias("place")] if "place" in res.columns else []))
    if "place" not in res.columns:
        res = rank_within(res, ["job_no"], [desc("promising"), desc("total_score"), "candidate"])
    info = (spark.read.schema("seconds_taken long").option("multiLine", True)
            .json(f"{root}/job_*/result/additional_info.json")
            .withColumn("job_no", F.regexp_extract(F.input_file_name(), _JOB_RE, 1).try_cast("int")))
    return res, info.select("job_no", "seconds_taken")


#: Types of an overview's fixed columns; every ``score (<type>)`` is a double, other columns stay text.
OVERVIEW_TYPES = {"candidate_id": "bigint", "place": "bigint", "promising": "boolean", "total_score": "double", "job_id": "string"}


def read_overview(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """S6 on the layout that ``sinks.write_overview`` writes (S8): the overview with its types; ``place`` as written.

    ``types`` adds to ``OVERVIEW_TYPES`` or overrides it; a value that isn't of its column's type becomes null."""
    kinds = OVERVIEW_TYPES | (types or {})
    raw = spark.read.option("header", True).csv(path)
    of = lambda c: kinds.get(c, "double" if c.startswith("score (") else "string")
    return raw.select(*[F.col(f"`{c}`").try_cast(of(c)).alias(c) for c in raw.columns])


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """Matrix cells as ``sinks.write_matrices`` writes them (S10): ``metric, job_id, entity_a, entity_b, value``."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c).cast("string").alias(c) for c in ("metric", "job_id", "entity_a", "entity_b")],
                      F.col("value").try_cast("double").alias("value"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation report of S11 in long form: ``scope, job_id, metric, value``; a metric without a value has no row."""
    rows = spark.read.schema("scope string, job_id string, metrics string").json(path)
    return rows.select("scope", "job_id", F.explode(F.from_json("metrics", "map<string, double>")).alias("metric", "value"))


def read_run_info(spark: SparkSession, path: str) -> DataFrame:
    """Run info as ``sinks.write_run_info`` writes it (S12): ``job_id, seconds_taken``."""
    return spark.read.schema("job_id string, seconds_taken bigint").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Match records as ``sinks.write_records`` writes them (S9): ``job_id, candidate_id, record``."""
    return spark.read.schema("candidate_id bigint, record string, job_id string").json(path).select("job_id", "candidate_id", "record")


# ------------------------------------------------------ requirement types

def read_requirement_types(spark: SparkSession, path: str,
                           json_path: str = "$.generic_config.job_requirements_config") -> DataFrame:
    """The JSON object keyed by type -> ``(type, ord, definition,
    weighting)``; ``ord`` keeps the key order of the file (maps keep insertion
    order; a struct schema would sort the keys)."""
    txt = spark.read.text(path, wholetext=True)
    obj = F.get_json_object("value", json_path)
    m = F.from_json(obj, T.MapType(T.StringType(), T.StructType([
        T.StructField("definition", T.StringType()), T.StructField("weighting", T.IntegerType())])))
    return (txt.select(F.posexplode(m).alias("ord", "type", "v"))
            .select("type", F.col("ord").cast("int").alias("ord"), F.col("v.definition").alias("definition"),
                    F.col("v.weighting").alias("weighting")))
