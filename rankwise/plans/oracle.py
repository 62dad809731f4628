"""DuckDB text of the adapters, shared by the oracle SQL of the catalog.

Each constant is a ``WITH`` prefix fragment (``name AS (...)``) written in
plain SQL over the driver's views.  They mirror ``rankwise.plans.fixtures``.
"""

from __future__ import annotations

from rankwise.schemas import REQUIREMENT_TYPES

TYPE_LIST_SQL = "[" + ", ".join(f"'{t}'" for t, _ in REQUIREMENT_TYPES) + "]"
TYPES_VALUES_SQL = ", ".join(f"('{t}', {i}, {w})" for i, (t, w) in enumerate(REQUIREMENT_TYPES))

F1_SQL = f"""
types(type, ord, weighting) AS (VALUES {TYPES_VALUES_SQL}),
f1 AS (
  SELECT l_returnflag AS job_id, CAST(l_partkey AS BIGINT) AS candidate_id,
         ({TYPE_LIST_SQL})[l_linenumber] AS type,
         CASE WHEN l_linestatus = 'F' THEN 'mandatory' ELSE 'optional' END AS kind,
         CAST(floor(l_quantity * 2.5 - 10) AS INTEGER) AS raw_score
  FROM lineitem
),
scores AS (SELECT *, least(100, greatest(0, raw_score)) AS score FROM f1),
cat AS (
  SELECT job_id, candidate_id, type, sum(score) AS s, count(score) AS n
  FROM scores GROUP BY ALL
),
totals AS (
  SELECT c.job_id, c.candidate_id,
         round(sum(CAST(c.s AS DOUBLE) / c.n * t.weighting) / sum(CAST(t.weighting AS DOUBLE)), 9) AS total_score
  FROM cat c JOIN types t USING (type) GROUP BY ALL
),
mand AS (
  SELECT job_id, candidate_id, min(m) AS mandatory_floor FROM (
    SELECT job_id, candidate_id, type, avg(score) AS m FROM scores WHERE kind = 'mandatory' GROUP BY ALL
  ) GROUP BY ALL
),
decided AS (
  SELECT t.*, (t.total_score >= 50.0 AND coalesce(m.mandatory_floor >= 25.0, true)) AS promising
  FROM totals t LEFT JOIN mand m USING (job_id, candidate_id)
)"""

# brand volume and ballots (F2) and model ballots
F2_SQL = """
vol AS (
  SELECT l_returnflag AS job_id, CAST(l_linenumber - 1 AS INTEGER) AS rater_ord, p_brand AS candidate,
         sum(l_quantity) AS qty, count(*) AS n_rows
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
),
ballots AS (
  SELECT job_id, 'human_id: ' || rater_ord AS rater, rater_ord, candidate, place,
         place <= rater_ord + 6 AS promising
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, rater_ord ORDER BY qty DESC, candidate) AS place FROM vol)
),
headers AS (
  SELECT job_id, 'human_id: ' || rater_ord AS rater, rater_ord, CAST(1 + sum(n_rows) % 40 AS DOUBLE) AS minutes
  FROM vol GROUP BY ALL
),
mvol AS (SELECT job_id, candidate, sum(n_rows) AS n FROM vol GROUP BY ALL),
model AS (
  SELECT job_id, candidate, place, place <= 12 AS promising
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, candidate) AS place FROM mvol)
),
run_info AS (SELECT job_id, CAST(30 + sum(n) % 90 AS BIGINT) AS seconds_taken FROM mvol GROUP BY ALL)"""

# ballots whose candidates are parts
F2_PART_SQL = """
vol AS (
  SELECT l_returnflag AS job_id, CAST(l_linenumber - 1 AS INTEGER) AS rater_ord, CAST(l_partkey AS BIGINT) AS candidate,
         sum(l_quantity) AS qty FROM lineitem GROUP BY ALL
),
ballots AS (
  SELECT job_id, 'human_id: ' || rater_ord AS rater, rater_ord, candidate, place, place <= rater_ord * 50 + 100 AS promising
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, rater_ord ORDER BY qty DESC, candidate) AS place FROM vol)
),
model AS (SELECT job_id, candidate, place, promising FROM ballots WHERE false)"""

# consensus of the F2 ballots (majority set + four-key mean ranking)
CONSENSUS_SQL = """
nb AS (SELECT job_id, count(DISTINCT rater) AS n_ballots FROM ballots GROUP BY ALL),
maj AS (
  SELECT b.job_id, b.candidate, CAST(count(*) FILTER (WHERE b.promising) AS BIGINT) AS votes,
         CAST(nb.n_ballots AS BIGINT) AS n_ballots, count(*) FILTER (WHERE b.promising) * 2 > nb.n_ballots AS in_majority
  FROM ballots b JOIN nb USING (job_id) GROUP BY b.job_id, b.candidate, nb.n_ballots
),
mode_c AS (SELECT job_id, candidate, place, count(*) AS c, min(rater_ord) AS f FROM ballots GROUP BY ALL),
modes AS (
  SELECT job_id, candidate, place AS mode_place FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, candidate ORDER BY c DESC, f ASC) AS rn FROM mode_c
  ) WHERE rn = 1
),
stats AS (
  SELECT job_id, candidate, sum(place) AS ps, count(*) AS pn, min(place) AS min_place, max(place) AS max_place,
         min(rater_ord) AS first_rater
  FROM ballots GROUP BY ALL
),
cons_rank AS (
  SELECT s.*, m.mode_place, CAST(s.ps AS DOUBLE) / s.pn AS mean_place,
         row_number() OVER (PARTITION BY s.job_id ORDER BY CAST(s.ps AS DOUBLE) / s.pn, m.mode_place, s.min_place,
                            s.max_place, s.first_rater, s.candidate) AS place
  FROM stats s JOIN modes m USING (job_id, candidate)
),
consensus AS (
  SELECT c.job_id, c.candidate, c.place, j.in_majority AS promising FROM cons_rank c JOIN maj j USING (job_id, candidate)
),
model_b AS (SELECT job_id, 'model' AS rater, 1073741824 AS rater_ord, candidate, place, promising FROM model)"""


def compare_sql(name: str, x: str, r: str, method: str = "rank") -> str:
    """CTE ``name(job_id, rater, hamming, tau, n)``: every ballot of ``x`` against
    the one ballot per job of ``r`` (brute force pairs: the oracle only)."""
    if method == "rank":
        pair = (f"FROM {x} x1 JOIN {x} x2 ON x1.job_id = x2.job_id AND x1.rater = x2.rater AND x1.candidate < x2.candidate "
                f"JOIN {r} r1 ON r1.job_id = x1.job_id AND r1.candidate = x1.candidate "
                f"JOIN {r} r2 ON r2.job_id = x2.job_id AND r2.candidate = x2.candidate")
        disc = "sign(x1.place - x2.place) * sign(r1.place - r2.place) < 0"
        nj = f"FROM {x} x JOIN {r} r ON x.job_id = r.job_id AND x.candidate = r.candidate"
    else:
        pair = (f"FROM {x} x1 JOIN {x} x2 ON x1.job_id = x2.job_id AND x1.rater = x2.rater AND x1.place < x2.place "
                f"JOIN {r} r1 ON r1.job_id = x1.job_id AND r1.place = x1.place "
                f"JOIN {r} r2 ON r2.job_id = x2.job_id AND r2.place = x2.place")
        disc = "(x1.candidate < x2.candidate) <> (r1.candidate < r2.candidate)"
        nj = f"FROM {x} x JOIN {r} r ON x.job_id = r.job_id AND x.place = r.place"
    return f"""
{name}_d AS (SELECT x1.job_id, x1.rater, count(*) FILTER (WHERE {disc}) AS d {pair} GROUP BY ALL),
{name}_n AS (SELECT x.job_id, x.rater, count(*) AS n {nj} GROUP BY ALL),
{name}_h AS (
  SELECT s.job_id, s.rater, CAST(s.k + coalesce(t.k, 0) - 2 * s.both_k AS BIGINT) AS hamming
  FROM (SELECT x.job_id, x.rater, count(*) FILTER (WHERE x.promising) AS k,
               count(*) FILTER (WHERE x.promising AND r.promising) AS both_k
        FROM {x} x LEFT JOIN {r} r ON x.job_id = r.job_id AND x.candidate = r.candidate GROUP BY ALL) s
  LEFT JOIN (SELECT job_id, count(*) FILTER (WHERE promising) AS k FROM {r} GROUP BY ALL) t USING (job_id)
),
{name} AS (
  SELECT h.job_id, h.rater, h.hamming,
         CASE WHEN n.n >= 2 THEN 1.0 - 4.0 * coalesce(d.d, 0) / (n.n * (n.n - 1)) END AS tau, CAST(n.n AS BIGINT) AS n
  FROM {name}_h h LEFT JOIN {name}_n n USING (job_id, rater) LEFT JOIN {name}_d d USING (job_id, rater)
)"""


def pairwise_sql(name: str, ents: str, method: str = "rank") -> str:
    """CTE ``name(job_id, entity_a, entity_b, hamming, tau, n)`` over all entity pairs."""
    if method == "rank":
        pair = (f"FROM {ents} a1 JOIN {ents} a2 ON a1.job_id = a2.job_id AND a1.rater = a2.rater AND a1.candidate < a2.candidate "
                f"JOIN {ents} b1 ON b1.job_id = a1.job_id AND b1.candidate = a1.candidate "
                f"JOIN {ents} b2 ON b2.job_id = a1.job_id AND b2.rater = b1.rater AND b2.candidate = a2.candidate")
        disc = "sign(a1.place - a2.place) * sign(b1.place - b2.place) < 0"
        nj = f"FROM {ents} a JOIN {ents} b ON a.job_id = b.job_id AND a.candidate = b.candidate"
    else:
        pair = (f"FROM {ents} a1 JOIN {ents} a2 ON a1.job_id = a2.job_id AND a1.rater = a2.rater AND a1.place < a2.place "
                f"JOIN {ents} b1 ON b1.job_id = a1.job_id AND b1.place = a1.place "
                f"JOIN {ents} b2 ON b2.job_id = a1.job_id AND b2.rater = b1.rater AND b2.place = a2.place")
        disc = "(a1.candidate < a2.candidate) <> (b1.candidate < b2.candidate)"
        nj = f"FROM {ents} a JOIN {ents} b ON a.job_id = b.job_id AND a.place = b.place"
    return f"""
{name}_d AS (SELECT a1.job_id, a1.rater AS entity_a, b1.rater AS entity_b, count(*) FILTER (WHERE {disc}) AS d
             {pair} GROUP BY ALL),
{name}_n AS (SELECT a.job_id, a.rater AS entity_a, b.rater AS entity_b, count(*) AS n {nj} GROUP BY ALL),
{name}_h AS (
  SELECT a.job_id, a.rater AS entity_a, b.rater AS entity_b,
         CAST(count(*) FILTER (WHERE a.promising <> b.promising) AS BIGINT) AS hamming
  FROM {ents} a JOIN {ents} b ON a.job_id = b.job_id AND a.candidate = b.candidate GROUP BY ALL
),
{name} AS (
  SELECT h.job_id, h.entity_a, h.entity_b, h.hamming,
         CASE WHEN n.n >= 2 THEN 1.0 - 4.0 * coalesce(d.d, 0) / (n.n * (n.n - 1)) END AS tau, CAST(n.n AS BIGINT) AS n
  FROM {name}_h h JOIN {name}_n n USING (job_id, entity_a, entity_b)
  LEFT JOIN {name}_d d USING (job_id, entity_a, entity_b)
)"""

# Python's str.strip set as a regex class (same text in Java and RE2)
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


F5_SQL = """
f5 AS (
  SELECT doc_id,
         CASE WHEN doc_id % 10 = 0 THEN regexp_replace(text, '^([^ ]*) ',
              '\\1' || CASE WHEN doc_id % 2 = 0 THEN chr(160) ELSE chr(8203) END) ELSE text END AS text,
         lang, source, n_chars
  FROM documents
)"""

FRONT_SQL = F5_SQL + f""",
types(type, ord, weighting) AS (VALUES {TYPES_VALUES_SQL}),
reqs AS (
  SELECT 'src' || CAST(item_id % 20 AS VARCHAR) AS job_id, item_id AS requirement_id,
         ({TYPE_LIST_SQL})[CAST(floor(item_id / 20) % 12 + 1 AS INTEGER)] AS type,
         CASE WHEN item_id % 3 = 0 THEN 'mandatory' ELSE 'optional' END AS kind, text AS specification
  FROM benchmark
),
docs AS (SELECT source AS job_id, doc_id AS candidate_id, text FROM f5)"""


F5B_SQL = """
f5b AS (
  SELECT event_id, CASE event_id % 10
    WHEN 0 THEN 'Sure: no object here, value ' || CAST(floor(value) AS BIGINT)
    WHEN 1 THEN 'Sure: {"value": "' || CAST(floor(value) AS BIGINT) || '", "explanation": "' || event_type || chr(10) || 'second line"} done'
    WHEN 2 THEN 'Sure: {"value": ' || CAST(floor(value) AS BIGINT) || '.5, "explanation": "' || event_type || '"} done'
    WHEN 3 THEN 'Sure: {"value": "high", "explanation": "' || event_type || '"} done'
    WHEN 4 THEN 'Sure: {"value": ' || CAST(floor(value) + 100 AS BIGINT) || ', "explanation": "' || event_type || '"} done'
    WHEN 5 THEN 'Sure: {"value": ' || CAST(floor(value) AS BIGINT) || '} done'
    WHEN 6 THEN 'Sure: {"value": ' || CAST(floor(value) AS BIGINT) || ', "explanation": "' || event_type || '"} {"value": 0} done'
    WHEN 7 THEN 'Sure: {"value": ' || CAST(floor(value) AS BIGINT) || ', "explanation": "' || event_type || '", "extra": ' || props || '} done'
    WHEN 8 THEN 'Sure: {"value": ' || CAST(floor(value) AS BIGINT) || ', "explanation": " ' || event_type || ' "} done'
    ELSE 'Sure: {"value": "' || CAST(floor(value) AS BIGINT) || '.0", "explanation": "' || event_type || '"} done'
  END AS answer FROM events
),
f5b_p AS (
  SELECT event_id, answer, obj, replace(obj, chr(10), '\\n') AS objn,
         regexp_replace(obj, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g') AS bare
  FROM (SELECT *, regexp_extract(answer, '(?s)\\{.*\\}', 0) AS obj FROM f5b)
),
f5b_v AS (
  SELECT event_id, answer, obj, bare, json_valid(objn) AS ok,
         CASE WHEN json_valid(objn) THEN json_extract_string(objn, '$.value') END AS v,
         CASE WHEN json_valid(objn) THEN json_extract_string(objn, '$.explanation') END AS e
  FROM f5b_p
),
parsed AS (
  SELECT event_id, answer,
    CASE WHEN regexp_full_match(trim(v), '[+-]?\\d+(\\.0*)?') THEN CAST(regexp_replace(trim(v), '\\.0*$', '') AS BIGINT) END AS value,
    """ + strip_sql("e") + """ AS explanation,
    CASE WHEN obj = '' THEN 'no_json'
         WHEN regexp_matches(bare, '\\}\\s*\\{') THEN 'not_one_object'
         WHEN NOT ok THEN 'malformed'
         WHEN v IS NULL THEN 'missing_value'
         WHEN NOT regexp_full_match(trim(v), '[+-]?\\d+(\\.0*)?') THEN 'bad_value'
         WHEN e IS NULL THEN 'missing_explanation'
    END AS reason
  FROM f5b_v
)"""

F5C_SQL = f"""
f5c AS (
  SELECT event_id, CASE event_id % 10
    WHEN 0 THEN '{{"not_a_type": [{{"type": "mandatory", "specification": "' || spec || '"}}]}}'
    WHEN 1 THEN '{{"' || t || '": "' || spec || '"}}'
    WHEN 2 THEN '{{"' || t || '": ["' || spec || '", 5]}}'
    WHEN 3 THEN '{{"' || t || '": [{{"type": "required", "specification": "' || spec || '"}}]}}'
    WHEN 4 THEN '{{"' || t || '": [{{"type": "optional"}}]}}'
    ELSE 'Result: {{"' || t || '": [{{"type": "mandatory", "specification": " ' || spec || ' "}}, {{"type": "optional", "specification": "' || spec || ' too"}}], "notes": "none"}} end'
  END AS answer
  FROM (SELECT event_id, ({TYPE_LIST_SQL})[CAST(event_id % 12 + 1 AS INTEGER)] AS t,
               event_type || ' level ' || CAST(floor(value) AS BIGINT) AS spec FROM events)
),
f5c_obj AS (SELECT event_id, regexp_extract(answer, '(?s)\\{{.*\\}}', 0) AS obj FROM f5c),
f5c_kv AS (SELECT event_id, obj, unnest(json_keys(obj)) AS req_type FROM f5c_obj WHERE obj <> ''),
f5c_lists AS (
  SELECT k.event_id, k.req_type, json_extract(k.obj, '$."' || k.req_type || '"') AS arr
  FROM f5c_kv k JOIN (VALUES {TYPES_VALUES_SQL}) AS ty(type, ord, weighting) ON ty.type = k.req_type
  WHERE json_type(k.obj, '$."' || k.req_type || '"') = 'ARRAY'
),
f5c_items AS (
  SELECT event_id, req_type, i AS req_pos, json_extract(arr, '$[' || i || ']') AS item
  FROM (SELECT *, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS i FROM f5c_lists)
),
reqs_parsed AS (
  SELECT event_id, req_type, CAST(req_pos AS BIGINT) AS req_pos,
         {strip_sql("json_extract_string(item, '$.type')")} AS kind,
         {strip_sql("json_extract_string(item, '$.specification')")} AS specification,
         CASE WHEN json_extract_string(item, '$.type') IS NULL THEN 'missing_type'
              WHEN {strip_sql("json_extract_string(item, '$.type')")} NOT IN ('mandatory', 'optional') THEN 'bad_type'
              WHEN json_extract_string(item, '$.specification') IS NULL THEN 'missing_specification' END AS reason
  FROM f5c_items WHERE json_type(item) = 'OBJECT'
)"""

F4_SQL = """
f4 AS (
  SELECT 'job_' || c_nationkey || '/applicants/candidate_' || c_custkey || '.' ||
         (['pdf', 'docx', 'txt', 'png'])[CAST(c_custkey % 4 + 1 AS INTEGER)] AS path FROM customer
  UNION ALL
  SELECT 'job_' || n_nationkey || '/job_description.' || (['pdf', 'docx', 'txt'])[i + 1] AS path
  FROM nation, (SELECT unnest(range(3)) AS i) r
  WHERE (n_nationkey + i) % 3 <> 0 AND n_nationkey % 5 <> 4
),
parsed AS (
  SELECT path, TRY_CAST(regexp_extract(path, 'job_(\\d+)/', 1) AS INTEGER) AS job_no,
         CASE WHEN regexp_extract(path, 'candidate_(\\d+)\\.([A-Za-z0-9]+)$', 1) <> ''
              THEN CAST(regexp_extract(path, 'candidate_(\\d+)\\.([A-Za-z0-9]+)$', 1) AS BIGINT) END AS candidate_no,
         lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS suffix,
         CASE WHEN regexp_extract(path, 'candidate_(\\d+)\\.([A-Za-z0-9]+)$', 1) <> '' THEN 'candidate'
              WHEN regexp_extract(path, 'job_(\\d+)/job_description\\.([A-Za-z0-9]+)$', 2) <> '' THEN 'job_description'
              ELSE 'other' END AS kind
  FROM f4
),
cands AS (SELECT * FROM parsed WHERE kind = 'candidate' AND suffix IN ('pdf', 'docx', 'txt')),
jd AS (SELECT *, list_position(['pdf', 'docx', 'txt'], suffix) AS prio FROM parsed WHERE kind = 'job_description'),
best AS (SELECT job_no, arg_min(path, prio) AS job_path, arg_min(suffix, prio) AS suffix FROM jd GROUP BY ALL)"""
