"""Adapters F1-F9: the reference's input shapes derived from the driver's tables.

Each adapter is a lazy DataFrame over whole tables, so its work grows with
the data.  The matching DuckDB text lives in ``rankwise.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwise.operators.ranking import desc, rank_within
from rankwise.session import checkpointed
from rankwise.schemas import KIND_MANDATORY, KIND_OPTIONAL, REQUIREMENT_TYPES
from rankwise.sources.tables import table

TYPE_NAMES = [t for t, _ in REQUIREMENT_TYPES]


def _type_by_index(idx_col) -> F.Column:
    """1-based index -> configured requirement type name (12-entry literal map)."""
    m = F.create_map(*[x for i, t in enumerate(TYPE_NAMES) for x in (F.lit(i + 1), F.lit(t))])
    return m[idx_col]


def f1_requirement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: ``(job_id, candidate_id, type, kind, raw_score)``, every row of ``lineitem``.

    Candidates are parts: a job has a handful of rows for each, so most
    candidates lack some types, which exercises the renormalised total.
    """
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.col("l_returnflag").alias("job_id"),
                    F.col("l_partkey").cast("bigint").alias("candidate_id"),
                    _type_by_index(F.col("l_linenumber")).alias("type"),
                    F.when(F.col("l_linestatus") == "F", F.lit(KIND_MANDATORY))
                    .otherwise(F.lit(KIND_OPTIONAL)).alias("kind"),
                    F.floor(F.col("l_quantity") * 2.5 - 10).cast("int").alias("raw_score")))


def brand_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem join part aggregated to (job, rater_ord, brand).

    The join shuffles on the part key (AQE broadcasts ``part`` when its
    runtime size is small); the partial aggregate after the join shrinks
    each task's output to at most 3 x 7 x 25 rows before the final shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(part, li.l_partkey == part.p_partkey, "inner")
    vol = (joined.groupBy(F.col("l_returnflag").alias("job_id"),
                          (F.col("l_linenumber") - 1).cast("int").alias("rater_ord"),
                          F.col("p_brand").alias("candidate"))
           .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_rows")))
    # the aggregate feeds ballots, headers and model ballots: write it once
    return checkpointed(vol)


def rater_name(ord_col) -> F.Column:
    return F.concat(F.lit("human_id: "), ord_col.cast("string"))


def f2_ballots(spark: SparkSession, sf_dir: str, vol: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """human ballots ``(job_id, rater, rater_ord, candidate, place, promising)``
    and headers ``(job_id, rater, rater_ord, minutes)``.  A query that also
    needs F3 takes both from one ``vol`` (``brand_volume``)."""
    vol = brand_volume(spark, sf_dir) if vol is None else vol
    ranked = rank_within(vol, ["job_id", "rater_ord"], [desc("qty"), "candidate"])
    ballots = checkpointed(ranked.select("job_id", rater_name(F.col("rater_ord")).alias("rater"), "rater_ord",
                                         "candidate", "place",
                                         (F.col("place") <= F.col("rater_ord") + 6).alias("promising")))
    headers = (vol.groupBy("job_id", "rater_ord").agg(F.sum("n_rows").alias("n"))
               .select("job_id", rater_name(F.col("rater_ord")).alias("rater"), "rater_ord",
                       (F.lit(1) + F.col("n") % 40).cast("double").alias("minutes")))
    return ballots, headers


def f2_part_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 with parts as candidates: ballots whose length grows with the data (thousands of places each)."""
    li = table(spark, sf_dir, "lineitem")
    vol = (li.groupBy(F.col("l_returnflag").alias("job_id"), (F.col("l_linenumber") - 1).cast("int").alias("rater_ord"),
                      F.col("l_partkey").cast("bigint").alias("candidate")).agg(F.sum("l_quantity").alias("qty")))
    ranked = rank_within(vol, ["job_id", "rater_ord"], [desc("qty"), "candidate"])
    return checkpointed(ranked.select("job_id", rater_name(F.col("rater_ord")).alias("rater"), "rater_ord", "candidate", "place",
                                      (F.col("place") <= F.col("rater_ord") * 50 + 100).alias("promising")))


def f3_model_ballots(spark: SparkSession, sf_dir: str, vol: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """model ballots ``(job_id, candidate, place, promising)`` and run info
    ``(job_id, seconds_taken)``."""
    vol = (brand_volume(spark, sf_dir) if vol is None else vol).groupBy("job_id", "candidate").agg(F.sum("n_rows").alias("n"))
    ranked = rank_within(vol, ["job_id"], [desc("n"), "candidate"])
    ballots = checkpointed(ranked.select("job_id", "candidate", "place", (F.col("place") <= 12).alias("promising")))
    info = (vol.groupBy("job_id").agg(F.sum("n").alias("n"))
            .select("job_id", (F.lit(30) + F.col("n") % 90).cast("bigint").alias("seconds_taken")))
    return ballots, info


def f2_wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    """F2 in the wide questionnaire shape: one row per rater, per job a
    minutes column, a ``;`` list of promising names and one place column per
    candidate.  Returns the frame and its positional layout.

    The column list (jobs x candidates) is the width of the form and is
    read from the data once, like a pivot's value list.
    """
    ballots, headers = f2_ballots(spark, sf_dir)
    keys = [(r["job_id"], r["candidate"]) for r in
            ballots.select("job_id", "candidate").distinct().orderBy("job_id", "candidate").collect()]
    key_col = F.concat_ws("|", "job_id", "candidate")
    places = (ballots.withColumn("_key", key_col).groupBy("rater_ord")
              .pivot("_key", [f"{j}|{c}" for j, c in keys]).agg(F.first("place")))
    jobs = sorted({j for j, _ in keys})
    prom = (ballots.groupBy("job_id", "rater_ord")
            .agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("promising"), F.col("candidate")))), ";")
                 .alias("plist")))
    head = headers.join(prom, ["job_id", "rater_ord"])
    hw = head.groupBy("rater_ord").pivot("job_id", jobs).agg(F.first("minutes").alias("m"), F.first("plist").alias("p"))
    wide = places.join(hw, "rater_ord")
    layout = [{"job_id": j, "minutes": f"{j}_m", "promising": f"{j}_p",
               "places": [(f"{j}|{c}", f"Place of {c}") for jj, c in keys if jj == j]} for j in jobs]
    return wide, layout


# ------------------------------------------------------------- text adapters

NBSP, ZWSP = "\u00a0", "\u200b"


def f5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a no-break space (even ids) or a zero-width space
    (odd ids) in place of the first blank of every tenth document."""
    d = table(spark, sf_dir, "documents")
    inject = F.when(F.col("doc_id") % 2 == 0, F.lit(NBSP)).otherwise(F.lit(ZWSP))
    text = F.when(F.col("doc_id") % 10 == 0,
                  F.regexp_replace(F.col("text"), "^([^ ]*) ", F.concat(F.lit("$1"), inject)))
    return d.select("doc_id", F.coalesce(text, F.col("text")).alias("text"), "lang", "source", "n_chars")


def f_front(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scoring front: jobs are the 20 document sources; candidates are the
    documents of a source; the requirements of job ``src<k>`` are the
    ``benchmark`` items with ``item_id % 20 = k`` (type and kind by rule)."""
    docs = f5_documents(spark, sf_dir).select(F.col("source").alias("job_id"),
                                              F.col("doc_id").alias("candidate_id"), "text")
    b = table(spark, sf_dir, "benchmark")
    reqs = b.select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("job_id"),
                    F.col("item_id").alias("requirement_id"),
                    _type_by_index((F.floor(F.col("item_id") / 20) % 12 + 1).cast("int")).alias("type"),
                    F.when(F.col("item_id") % 3 == 0, F.lit(KIND_MANDATORY)).otherwise(F.lit(KIND_OPTIONAL))
                    .alias("kind"),
                    F.col("text").alias("specification"))
    return reqs, docs


def f5b_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy score answers ``(event_id, answer)`` from ``events``; the
    defect class is ``event_id % 10``."""
    e = table(spark, sf_dir, "events")
    v = F.floor("value").cast("bigint").cast("string")
    t = F.col("event_type")
    k = F.col("event_id") % 10
    L = F.lit
    text = (F.when(k == 0, F.concat(L("Sure: no object here, value "), v))
            .when(k == 1, F.concat(L('Sure: {"value": "'), v, L('", "explanation": "'), t, L("\nsecond line\"} done")))
            .when(k == 2, F.concat(L('Sure: {"value": '), v, L('.5, "explanation": "'), t, L('"} done')))
            .when(k == 3, F.concat(L('Sure: {"value": "high", "explanation": "'), t, L('"} done')))
            .when(k == 4, F.concat(L('Sure: {"value": '), (F.floor("value") + 100).cast("bigint").cast("string"),
                                   L(', "explanation": "'), t, L('"} done')))
            .when(k == 5, F.concat(L('Sure: {"value": '), v, L("} done")))
            .when(k == 6, F.concat(L('Sure: {"value": '), v, L(', "explanation": "'), t, L('"} {"value": 0} done')))
            .when(k == 7, F.concat(L('Sure: {"value": '), v, L(', "explanation": "'), t, L('", "extra": '),
                                   F.col("props"), L("} done")))
            .when(k == 8, F.concat(L('Sure: {"value": '), v, L(', "explanation": " '), t, L(' "} done')))
            .otherwise(F.concat(L('Sure: {"value": "'), v, L('.0", "explanation": "'), t, L('"} done'))))
    return e.select("event_id", text.alias("answer"))


def f5c_requirement_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction answers ``(event_id, answer)`` from ``events``: defect class
    ``event_id % 10`` (unknown type, non-list, non-object items, bad kind,
    missing specification, then clean answers with two requirements)."""
    e = table(spark, sf_dir, "events")
    t = _type_by_index((F.col("event_id") % 12 + 1).cast("int"))
    spec = F.concat(F.col("event_type"), F.lit(" level "), F.floor("value").cast("bigint").cast("string"))
    k = F.col("event_id") % 10
    L = F.lit
    text = (F.when(k == 0, F.concat(L('{"not_a_type": [{"type": "mandatory", "specification": "'), spec, L('"}]}')))
            .when(k == 1, F.concat(L('{"'), t, L('": "'), spec, L('"}')))
            .when(k == 2, F.concat(L('{"'), t, L('": ["'), spec, L('", 5]}')))
            .when(k == 3, F.concat(L('{"'), t, L('": [{"type": "required", "specification": "'), spec, L('"}]}')))
            .when(k == 4, F.concat(L('{"'), t, L('": [{"type": "optional"}]}')))
            .otherwise(F.concat(L('Result: {"'), t, L('": [{"type": "mandatory", "specification": " '), spec,
                                L(' "}, {"type": "optional", "specification": "'), spec, L(' too"}], "notes": "none"} end'))))
    return e.select("event_id", text.alias("answer"))


def f5d_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5d: decision answers ``(event_id, answer)`` from ``events``; the defect
    class is ``event_id % 14``, every 97th has an explanation of 100,000 characters."""
    e = table(spark, sf_dir, "events")
    L = F.lit
    said = F.when(F.col("event_id") % 97 == 0, F.repeat(L('\\"so\\" {x} '), 10_000)).otherwise(F.col("event_type"))

    def text(value: str, tail: str = "}") -> F.Column:
        return F.concat(L('Well: {"promising": ' + value + ', "explanation": "'), said, L('"' + tail + " end"))
    bodies = [text("true"), text("false"), text('"Yes"'), text('"off"'), text("1"), text("0.0"), text("2"), text('"maybe"'),
              text("null"), text("[true]"), F.concat(L('{"promising": true, "explanation": '), F.col("event_id").cast("string"), L("}")),
              F.concat(L("I would say yes to "), F.col("event_type")), text("true", ""), text("true", '} {"promising": false}')]
    out = F.lit(None).cast("string")
    for k, body in enumerate(bodies):
        out = F.when(F.col("event_id") % len(bodies) == k, body).otherwise(out)
    return e.select("event_id", out.alias("answer"))


def f5e_bad_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5e: extraction answers ``(event_id, answer)`` from ``events``, good and bad by ``event_id % 7``."""
    e = table(spark, sf_dir, "events")
    item = lambda kind, spec: F.concat(F.lit('{"type": ' + kind + ', "specification": '), spec, F.lit("}"))
    spec = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    one = lambda x: F.concat(F.lit('So {"education": ['), x, F.lit("]}"))
    bodies = [F.concat(F.lit("no object for "), F.col("event_type")), F.concat(F.lit('{"education": ['), spec),
              F.concat(one(item('"mandatory"', spec)), F.lit(' {"x": 1}')), F.lit('{"education": [}'),
              one(item('"mandatory"', F.floor("value").cast("bigint").cast("string"))), one(item("3", spec)),
              one(item('"optional"', spec))]
    out = F.lit(None).cast("string")
    for k, body in enumerate(bodies):
        out = F.when(F.col("event_id") % len(bodies) == k, body).otherwise(out)
    return e.select("event_id", out.alias("answer"))


# ------------------------------------------------------------- path adapter

F4_SUFFIXES = ["pdf", "docx", "txt", "png"]


def f4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a document tree as paths - ``job_<nation>/applicants/candidate_<cust>.<ext>``
    (ext by ``c_custkey % 4``) plus ``job_<n>/job_description.<ext>`` for the
    suffixes ``i`` with ``(n + i) % 3 <> 0``; nations with ``n % 5 = 4`` have
    no job description."""
    cust = table(spark, sf_dir, "customer")
    ext = F.element_at(F.array(*[F.lit(s) for s in F4_SUFFIXES]), (F.col("c_custkey") % 4 + 1).cast("int"))
    cands = cust.select(F.concat(F.lit("job_"), F.col("c_nationkey").cast("string"), F.lit("/applicants/candidate_"),
                                 F.col("c_custkey").cast("string"), F.lit("."), ext).alias("path"))
    nat = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*[F.lit(s) for s in
                                                                                    F4_SUFFIXES[:3]])).alias("i", "s"))
    jd = (nat.filter(((F.col("n_nationkey") + F.col("i")) % 3 != 0) & (F.col("n_nationkey") % 5 != 4))
          .select(F.concat(F.lit("job_"), F.col("n_nationkey").cast("string"), F.lit("/job_description."),
                           F.col("s")).alias("path")))
    return cands.unionByName(jd)


def f4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 with contents ``(path, content)``: a candidate's file holds the document of the same number (or a fixed
    sentence where there is none), a job description the name of its nation."""
    from rankwise.sources.files import parse_paths
    paths = parse_paths(f4_paths(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_no"), F.col("text").alias("_cv"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("job_no"), F.col("n_name").alias("_job"))
    text = F.when(F.col("kind") == "candidate", F.coalesce("_cv", F.lit("no text"))).otherwise(F.col("_job"))
    return paths.join(docs, "candidate_no", "left").join(names, "job_no", "left").select("path", text.alias("content"))


def f3_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 as the files of a model run ``(path, content)``: per job a table of the candidates without places, and the run info.

    A job's number is the code of its letter; a job has as many candidates as there are brands (25)."""
    model, info = f3_model_ballots(spark, sf_dir)
    folder = F.concat(F.lit("job_"), F.ascii("job_id").cast("string"), F.lit("/result/"))
    line = F.concat_ws(",", "candidate", F.col("promising").cast("string"), (F.lit(100) - F.col("place")).cast("string"))
    tables = (model.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_lines"))
              .select(F.concat(folder, F.lit("job_match_result.csv")).alias("path"),
                      F.concat(F.lit("candidate,promising,total_score\n"), "_lines").alias("content")))
    infos = info.select(F.concat(folder, F.lit("additional_info.json")).alias("path"), F.to_json(F.struct("seconds_taken")).alias("content"))
    return tables.unionByName(infos)
