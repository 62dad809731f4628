"""Scoring front: answers (F5b), requirement extraction (F5c), fan-out,
native scorer, request texts and the end-to-end ranked overview on
``documents`` x ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwise.functions.columns import clamp, round6
from rankwise.operators import answers as ans, native_scorer as ns, scoring, templates
from rankwise.operators.text import normalise_documents
from rankwise.plans import fixtures as fx
from rankwise.plans.oracle import F5B_SQL, F5C_SQL, FRONT_SQL, strip_sql
from rankwise.plans.registry import register
from rankwise.schemas import REQUIREMENT_DEFINITIONS, requirement_types
from rankwise.session import checkpointed
from rankwise.sources.tables import table


def _front(spark, sf_dir):
    reqs, docs = fx.f_front(spark, sf_dir)
    return reqs, normalise_documents(docs, "text")


_NG = ("list_distinct(flatten([t, "
       "list_filter(list_transform(list_zip(t, t[2:]), lambda z: z[1] || ' ' || z[2]), lambda x: x IS NOT NULL), "
       "list_filter(list_transform(list_zip(t, t[2:], t[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3]), "
       "lambda x: x IS NOT NULL)]))")
_TOKS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0)"

NATIVE_SQL = FRONT_SQL + f""",
ndocs AS (SELECT job_id, candidate_id, replace(replace(text, chr(160), ' '), chr(8203), ' ') AS text FROM docs),
rq AS (SELECT job_id, requirement_id, unnest({_NG}) AS ngram
       FROM (SELECT *, {_TOKS.format(x='specification')} AS t FROM reqs)),
dn AS (SELECT job_id, candidate_id, unnest({_NG}) AS ngram
       FROM (SELECT *, {_TOKS.format(x='text')} AS t FROM ndocs)),
tot AS (SELECT job_id, requirement_id, count(*) AS total FROM rq GROUP BY ALL),
hit AS (SELECT rq.job_id, rq.requirement_id, dn.candidate_id, count(*) AS hits
        FROM rq JOIN dn ON rq.job_id = dn.job_id AND rq.ngram = dn.ngram GROUP BY ALL),
pairs AS (SELECT r.job_id, r.requirement_id, d.candidate_id FROM reqs r JOIN docs d ON r.job_id = d.job_id),
native AS (
  SELECT p.job_id, p.requirement_id, p.candidate_id, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits,
         CAST(coalesce(t.total, 0) AS BIGINT) AS total,
         CAST(CASE WHEN coalesce(t.total, 0) > 0 THEN floor(100 * coalesce(h.hits, 0) / t.total + 0.5) ELSE 0 END
              AS BIGINT) AS score
  FROM pairs p LEFT JOIN tot t USING (job_id, requirement_id)
  LEFT JOIN hit h USING (job_id, requirement_id, candidate_id)
)"""


# ------------------------------------------------------------- answers

@register("parsed_score_answers", f"""WITH {F5B_SQL}
SELECT event_id, CASE WHEN reason IS NULL THEN value END AS value,
       CASE WHEN reason IS NULL THEN explanation END AS explanation, reason FROM parsed""")
def q_parsed_score_answers(spark, sf_dir):
    p = ans.parse_answers(fx.f5b_answers(spark, sf_dir), "answer", {"value": "int", "explanation": "str"})
    ok = F.col("reason").isNull()
    return p.select("event_id", F.when(ok, F.col("value")).alias("value"),
                    F.when(ok, F.col("explanation")).alias("explanation"), "reason")


@register("answer_rejects", f"""WITH {F5B_SQL}
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM parsed WHERE reason IS NOT NULL GROUP BY ALL""")
def q_answer_rejects(spark, sf_dir):
    p = ans.parse_answers(fx.f5b_answers(spark, sf_dir), "answer", {"value": "int", "explanation": "str"})
    return ans.rejected_answers(p).groupBy("reason").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("clamped_answers", f"""WITH {F5B_SQL}
SELECT event_id, value AS raw_value, least(100, greatest(0, value)) AS score FROM parsed WHERE reason IS NULL""")
def q_clamped_answers(spark, sf_dir):
    p = ans.valid_answers(ans.parse_answers(fx.f5b_answers(spark, sf_dir), "answer",
                                            {"value": "int", "explanation": "str"}))
    return p.select("event_id", F.col("value").alias("raw_value"), clamp("value", 0, 100).alias("score"))


@register("parsed_requirements", f"""WITH {F5C_SQL}
SELECT event_id, req_type, req_pos, kind, specification, reason FROM reqs_parsed""")
def q_parsed_requirements(spark, sf_dir):
    r = ans.parse_requirements(fx.f5c_requirement_answers(spark, sf_dir), "answer", F.broadcast(requirement_types(spark)))
    return r.select("event_id", "req_type", F.col("req_pos").cast("bigint").alias("req_pos"), "kind",
                    "specification", "reason")


@register("parsed_decisions", """
SELECT event_id, CASE WHEN k IN (0, 2, 4) THEN true WHEN k IN (1, 3, 5) THEN false END AS promising,
       CASE WHEN k < 6 THEN CAST(length(CASE WHEN event_id % 97 = 0 THEN trim(repeat('"so" {x} ', 10000)) ELSE event_type END) AS BIGINT)
            END AS explanation_chars,
       CASE WHEN k < 6 THEN NULL WHEN k < 10 THEN 'bad_promising' WHEN k = 10 THEN 'bad_explanation'
            WHEN k = 11 THEN 'no_json' WHEN k = 12 AND event_id % 97 <> 0 THEN 'no_json' ELSE 'not_one_object' END AS reason
FROM (SELECT *, event_id % 14 AS k FROM events)""")
def q_parsed_decisions(spark, sf_dir):
    """P3 on the decision answer; the SQL names each defect class's outcome."""
    p = ans.parse_answers(fx.f5d_decisions(spark, sf_dir), "answer", {"promising": "bool", "explanation": "str"})
    ok = F.col("reason").isNull()
    return p.select("event_id", F.when(ok, F.col("promising")).alias("promising"),
                    F.when(ok, F.length("explanation").cast("bigint")).alias("explanation_chars"), "reason")


@register("extraction_rejects", """
SELECT event_id, CASE WHEN k > 3 THEN 'education' END AS req_type, CASE WHEN k IN (4, 6) THEN CASE WHEN k = 4 THEN 'mandatory' ELSE 'optional' END END AS kind,
       CASE WHEN k IN (5, 6) THEN event_type END AS specification,
       CASE k WHEN 0 THEN 'no_json' WHEN 1 THEN 'no_json' WHEN 2 THEN 'not_one_object' WHEN 3 THEN 'malformed'
              WHEN 4 THEN 'bad_specification' WHEN 5 THEN 'bad_type' END AS reason
FROM (SELECT *, event_id % 7 AS k FROM events)""")
def q_extraction_rejects(spark, sf_dir):
    """Every bad extraction answer keeps a row with its reason."""
    r = ans.parse_requirements(fx.f5e_bad_extractions(spark, sf_dir), "answer", F.broadcast(requirement_types(spark)))
    return r.select("event_id", "req_type", "kind", "specification", "reason")


# ------------------------------------------------------- fan-out and scorer

@register("requirement_fan_out", f"""WITH {FRONT_SQL}
SELECT r.job_id, r.requirement_id, d.candidate_id FROM reqs r JOIN docs d ON r.job_id = d.job_id""")
def q_requirement_fan_out(spark, sf_dir):
    reqs, docs = fx.f_front(spark, sf_dir)
    return ns.fan_out(reqs, docs)


@register("native_scores", f"""WITH {NATIVE_SQL}
SELECT job_id, requirement_id, candidate_id, hits, total, score FROM native""")
def q_native_scores(spark, sf_dir):
    reqs, docs = _front(spark, sf_dir)
    s = ns.overlap_scores(reqs, docs)
    return s.select("job_id", "requirement_id", "candidate_id", "hits", "total",
                    F.col("score").cast("bigint").alias("score"))


def _defs_values() -> str:
    return ", ".join("('{}', '{}')".format(t, d.replace("'", "''")) for t, d in REQUIREMENT_DEFINITIONS.items())


def _render_sql(template: str = "match", dyn: dict[str, str] | None = None) -> str:
    """A request built with nested replace() in the same order."""
    static = templates.static_values()
    out = "'" + templates.TEMPLATES[template].replace("'", "''") + "'"
    for name in templates.STATIC_ORDER:
        out = f"replace({out}, '{{{name}}}', '{static[name].strip().replace(chr(39), chr(39) * 2)}')"
    dyn = dyn or {"CV_TEXT": "d.text", "REQUIREMENT_SPECIFICATION": "r.specification", "REQUIREMENT_TYPE_NAME": "r.type",
                  "REQUIREMENT_TYPE_DEFINITION": "df.definition"}
    for name in templates.DYNAMIC_ORDER:
        if name in dyn:
            out = f"replace({out}, '{{{name}}}', coalesce({strip_sql(dyn[name])}, ''))"
    return out


@register("match_requests", f"""WITH {FRONT_SQL}, defs(type, definition) AS (VALUES {_defs_values()}),
ndocs AS (SELECT job_id, candidate_id, replace(replace(text, chr(160), ' '), chr(8203), ' ') AS text FROM docs)
SELECT r.job_id, r.requirement_id, d.candidate_id, CAST(length(p) AS BIGINT) AS prompt_chars, md5(p) AS prompt_md5
FROM (SELECT r.job_id, r.requirement_id, d.candidate_id, {_render_sql()} AS p
      FROM reqs r JOIN ndocs d ON r.job_id = d.job_id JOIN defs df ON df.type = r.type) q
JOIN reqs r USING (job_id, requirement_id) JOIN ndocs d USING (job_id, candidate_id)""")
def q_match_requests(spark, sf_dir):
    reqs, docs = _front(spark, sf_dir)
    defs = F.broadcast(requirement_types(spark).select("type", "definition"))        # J2
    pairs = ns.fan_out(reqs, docs)
    full = (pairs.join(reqs.join(defs, "type"), ["job_id", "requirement_id"])
            .join(docs, ["job_id", "candidate_id"]))
    prompt = templates.match_request(F.col("text"), F.col("specification"), F.col("type"), F.col("definition"))
    return full.select("job_id", "requirement_id", "candidate_id", F.length(prompt).cast("bigint").alias("prompt_chars"),
                       F.md5(prompt).alias("prompt_md5"))


@register("other_requests", f"""
SELECT doc_id, md5({_render_sql("extract", {"JOB_TEXT": "text"})}) AS extract_md5,
       md5({_render_sql("prettify", {"TEXT": "text"})}) AS prettify_md5,
       md5({_render_sql("decide", {"REQUIREMENT_MATCHES": "'[' || doc_id || ']'"})}) AS decide_md5
FROM documents""")
def q_other_requests(spark, sf_dir):
    """The extraction, clean-up and decision requests."""
    d = table(spark, sf_dir, "documents")
    matches = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))
    return d.select("doc_id", F.md5(templates.extract_request(F.col("text"))).alias("extract_md5"),
                    F.md5(templates.prettify_request(F.col("text"))).alias("prettify_md5"),
                    F.md5(templates.decide_request(matches)).alias("decide_md5"))


# ---------------------------------------------------------------- end to end

def _front_scores(spark, sf_dir):
    """X22 -> X1 clamp -> long score table for the aggregation operators.  The
    native scorer's columns are taken as they are; ``answered_scores`` goes
    through answer texts."""
    reqs, docs = _front(spark, sf_dir)
    scores = (ns.overlap_scores(reqs, docs).join(reqs.select("job_id", "requirement_id", "type", "kind"), ["job_id", "requirement_id"])
              .select("job_id", "candidate_id", "requirement_id", "type", "kind",
                      clamp("score", 0, 100).cast("int").alias("score"), "explanation"))
    # the long score table feeds totals, decision and records: write it once
    return reqs, docs, checkpointed(scores)


@register("answered_scores", f"""WITH {NATIVE_SQL}
SELECT job_id, requirement_id, candidate_id, score, CAST(NULL AS VARCHAR) AS reason FROM native""")
def q_answered_scores(spark, sf_dir):
    """X21 + X15 + P3 + J3: one request per distinct (job, requirement text, document text), answered as text by the
    scorer, parsed, and joined back to every pair."""
    reqs, docs = _front(spark, sf_dir)
    reqs, docs = reqs.withColumn("spec_key", F.md5("specification")), docs.withColumn("text_key", F.md5("text"))
    pairs = (reqs.select("job_id", "requirement_id", "spec_key")
             .join(docs.select("job_id", "candidate_id", "text_key"), "job_id"))

    def scorer(keys):
        r = reqs.groupBy("job_id", F.col("spec_key").alias("requirement_id")).agg(F.min("specification").alias("specification"))
        d = docs.groupBy("job_id", F.col("text_key").alias("candidate_id")).agg(F.min("text").alias("text"))
        a = ns.native_answers(r, d).withColumnsRenamed({"requirement_id": "spec_key", "candidate_id": "text_key"})
        return keys.join(a, ["job_id", "spec_key", "text_key"])

    answered = ans.answer(pairs, ["job_id", "spec_key", "text_key"], scorer)
    p = ans.parse_answers(answered, "answer", {"value": "int", "explanation": "str"})
    return p.select("job_id", "requirement_id", "candidate_id", F.col("value").alias("score"), "reason")


@register("scored_overview", f"""WITH {NATIVE_SQL},
sc AS (SELECT n.job_id, n.candidate_id, r.type, r.kind, least(100, greatest(0, n.score)) AS score
       FROM native n JOIN reqs r USING (job_id, requirement_id)),
cat AS (SELECT job_id, candidate_id, type, sum(score) AS s, count(*) AS n FROM sc GROUP BY ALL),
totals AS (
  SELECT c.job_id, c.candidate_id,
         round(sum(CAST(c.s AS DOUBLE) / c.n * t.weighting) / sum(CAST(t.weighting AS DOUBLE)), 9) AS total_score
  FROM cat c JOIN types t USING (type) GROUP BY ALL
),
mand AS (SELECT job_id, candidate_id, min(m) AS mf FROM (
           SELECT job_id, candidate_id, type, avg(score) AS m FROM sc WHERE kind = 'mandatory' GROUP BY ALL) GROUP BY ALL),
dec AS (SELECT t.*, (t.total_score >= 50.0 AND coalesce(m.mf >= 25.0, true)) AS promising
        FROM totals t LEFT JOIN mand m USING (job_id, candidate_id))
SELECT job_id, candidate_id,
       CAST(row_number() OVER (PARTITION BY job_id ORDER BY promising DESC, total_score DESC, candidate_id) AS BIGINT)
         AS place, promising, round(total_score, 6) AS total_score
FROM dec""")
def q_scored_overview(spark, sf_dir):
    reqs, docs, scores = _front_scores(spark, sf_dir)
    totals = scoring.weighted_totals(scores, requirement_types(spark))
    decided = scoring.decide_promising(totals)
    ranked = scoring.rank_candidates(decided)
    return ranked.select("job_id", "candidate_id", F.col("place").cast("bigint").alias("place"), "promising",
                         round6("total_score").alias("total_score"))


@register("match_records", f"""WITH {NATIVE_SQL},
sc AS (SELECT n.job_id, n.candidate_id, r.type, least(100, greatest(0, n.score)) AS score
       FROM native n JOIN reqs r USING (job_id, requirement_id))
SELECT job_id, candidate_id, CAST(count(DISTINCT type) AS BIGINT) AS n_types, CAST(count(*) AS BIGINT) AS n_matches,
       CAST(sum(score) AS BIGINT) AS score_sum
FROM sc GROUP BY ALL""")
def q_match_records(spark, sf_dir):
    """X16 + S9: one nested record per candidate serialised with ``to_json``;
    the fields are read back from the JSON text to prove the round trip."""
    from rankwise.sinks.records import match_records
    reqs, docs, scores = _front_scores(spark, sf_dir)
    totals = scoring.decide_promising(scoring.weighted_totals(scores, requirement_types(spark)), scores)
    scores = scores.join(reqs.select("job_id", "requirement_id", "specification"), ["job_id", "requirement_id"])
    rec = match_records(scores, totals)
    parsed = rec.select("job_id", "candidate_id",
                        F.from_json("record", "struct<requirement_matches: map<string, array<struct<"
                                              "score: struct<value: int>>>>>").alias("r"))
    matches = F.flatten(F.map_values("r.requirement_matches"))
    return parsed.select("job_id", "candidate_id",
                         F.size(F.map_keys("r.requirement_matches")).cast("bigint").alias("n_types"),
                         F.size(matches).cast("bigint").alias("n_matches"),
                         F.aggregate(matches, F.lit(0).cast("bigint"),
                                     lambda acc, m: acc + m["score"]["value"]).alias("score_sum"))


_ABOVE, _BELOW = "total and mandatory requirements above the thresholds", "total or a mandatory requirement below its threshold"


@register("translated_records", f"""WITH {NATIVE_SQL},
sc AS (SELECT n.job_id, n.candidate_id, r.type, r.kind, least(100, greatest(0, n.score)) AS score
       FROM native n JOIN reqs r USING (job_id, requirement_id)),
cat AS (SELECT job_id, candidate_id, type, sum(score) AS s, count(*) AS n FROM sc GROUP BY ALL),
totals AS (
  SELECT c.job_id, c.candidate_id,
         round(sum(CAST(c.s AS DOUBLE) / c.n * t.weighting) / sum(CAST(t.weighting AS DOUBLE)), 9) AS total_score
  FROM cat c JOIN types t USING (type) GROUP BY ALL
),
mand AS (SELECT job_id, candidate_id, min(m) AS mf FROM (
           SELECT job_id, candidate_id, type, avg(score) AS m FROM sc WHERE kind = 'mandatory' GROUP BY ALL) GROUP BY ALL),
dec AS (SELECT t.*, (t.total_score >= 50.0 AND coalesce(m.mf >= 25.0, true)) AS promising
        FROM totals t LEFT JOIN mand m USING (job_id, candidate_id)),
texts AS (
  SELECT n.job_id, n.candidate_id, r.type, r.requirement_id,
         CASE WHEN r.requirement_id % 2 = 0 THEN 'T:' || r.specification ELSE r.specification END AS spec,
         CASE WHEN n.hits = 0 THEN 'N:' ELSE '' END || n.hits || ' of ' || n.total || ' requirement n-grams found in the document' AS said
  FROM native n JOIN reqs r USING (job_id, requirement_id))
SELECT t.job_id, t.candidate_id, CASE WHEN any_value(d.promising) THEN '{_ABOVE}' ELSE 'P:{_BELOW}' END AS explanation,
       md5(string_agg(spec || '|' || said, chr(10) ORDER BY t.type, requirement_id)) AS matches_md5
FROM texts t JOIN dec d USING (job_id, candidate_id) GROUP BY ALL""")
def q_translated_records(spark, sf_dir):
    """X11: the output fields of every match record out of a memory that knows half of the specifications, the
    explanations of matches without a hit and one of the decision; the others stay."""
    from rankwise.operators import text as tx
    from rankwise.sinks.records import match_records
    reqs, docs, scores = _front_scores(spark, sf_dir)
    decided = scoring.decide_promising(scoring.weighted_totals(scores, requirement_types(spark)))
    rec = match_records(scores.join(reqs.select("job_id", "requirement_id", "specification"), ["job_id", "requirement_id"]), decided)
    rec = rec.select("job_id", "candidate_id", F.from_json("record", tx.RECORD).alias("r"))
    known = [reqs.where("requirement_id % 2 = 0").select(F.col("specification").alias("text"), F.lit("T:").alias("mark")),
             scores.where("explanation like '0 of %'").select(F.col("explanation").alias("text"), F.lit("N:").alias("mark")),
             spark.createDataFrame([(_BELOW, "P:")], "text string, mark string")]
    memory = known[0].union(known[1]).union(known[2]).distinct().select(F.md5("text").alias("text_md5"), F.concat("mark", "text").alias("translated"))
    out = tx.translate_records(rec, ["job_id", "candidate_id"], memory, "de")
    by_type = F.array_sort(F.map_entries("r.requirement_matches"))
    lines = F.flatten(F.transform(by_type, lambda e: F.transform(e["value"], lambda m: F.concat_ws(
        "|", m["requirement"]["specification"], m["score"]["explanation"]))))
    return out.select("job_id", "candidate_id", F.col("r.promising_result.explanation").alias("explanation"),
                      F.md5(F.array_join(lines, "\n")).alias("matches_md5"))
