"""Text queries: page assembly (X7), normalisation (X8/X9), language tags
(X10), translation work list (X11), redaction (X17/X18), link removal
(X19), pseudonyms (X20) and name checks (P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwise.operators import text as tx
from rankwise.plans import fixtures as fx
from rankwise.plans.oracle import F5_SQL, WS, strip_sql
from rankwise.plans.registry import register
from rankwise.sources.tables import table

_TOKS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0)"


def _profile_sql() -> str:
    langs = sorted(tx.LANGUAGE_PROFILES)
    return ", ".join(f"('{lang}', {langs.index(lang)}, '{w}')"
                     for lang, words in tx.LANGUAGE_PROFILES.items() for w in words)


@register("page_text_assembly", f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_pages,
       md5(string_agg({strip_sql('text')}, chr(10) ORDER BY turn)) AS text_md5,
       CAST(length(string_agg({strip_sql('text')}, chr(10) ORDER BY turn)) AS BIGINT) AS n_chars
FROM conversations GROUP BY ALL""")
def q_page_text_assembly(spark, sf_dir):
    """X7 with conversation turns as the pages of a document."""
    conv = table(spark, sf_dir, "conversations")
    doc = tx.assemble_pages(conv, ["conv_id"], "turn", "text")
    n = conv.groupBy("conv_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_pages"))
    return doc.join(n, "conv_id").select("conv_id", "n_pages", F.md5("text").alias("text_md5"),
                                         F.length("text").cast("bigint").alias("n_chars"))


@register("normalized_documents", f"""WITH {F5_SQL}
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5,
       CAST(length(text) - length(replace(replace(text, chr(160), ''), chr(8203), '')) AS BIGINT) AS n_replaced
FROM (SELECT doc_id, text, replace(replace(text, chr(160), ' '), chr(8203), ' ') AS t FROM f5)""")
def q_normalized_documents(spark, sf_dir):
    d = fx.f5_documents(spark, sf_dir)
    n = tx.normalise_documents(d.withColumnRenamed("text", "t").withColumn("text", F.col("t")), "t")
    removed = F.length("text") - F.length(F.replace(F.replace("text", F.lit(fx.NBSP), F.lit("")),
                                                    F.lit(fx.ZWSP), F.lit("")))
    return n.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_md5"),
                    removed.cast("bigint").alias("n_replaced"))


LANG_SQL = f"""WITH {F5_SQL}, prof(lang, lang_rank, token) AS (VALUES {_profile_sql()}),
nd AS (SELECT doc_id, lang AS given, replace(replace(text, chr(160), ' '), chr(8203), ' ') AS text FROM f5),
tk AS (SELECT doc_id, unnest({_TOKS.format(x='text')}) AS token FROM nd),
h AS (SELECT doc_id, lang, lang_rank, count(*) AS hits FROM tk JOIN prof USING (token) GROUP BY ALL),
best AS (SELECT doc_id, lang AS detected, hits FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang_rank) AS rn FROM h) WHERE rn = 1),
tags AS (SELECT nd.doc_id, nd.given, b.detected, CAST(b.hits AS BIGINT) AS hits, nd.text
         FROM nd LEFT JOIN best b USING (doc_id))"""


@register("language_tags", f"""{LANG_SQL}
SELECT doc_id, given, detected, hits, coalesce(given = detected, false) AS agrees FROM tags""")
def q_language_tags(spark, sf_dir):
    d = tx.normalise_documents(fx.f5_documents(spark, sf_dir))
    tags = tx.detect_language(d, "doc_id")
    return (d.select("doc_id", F.col("lang").alias("given")).join(tags, "doc_id", "left")
            .select("doc_id", "given", "detected", F.col("hits").cast("bigint").alias("hits"),
                    F.coalesce(F.col("given") == F.col("detected"), F.lit(False)).alias("agrees")))


_LANGS = sorted(tx.LANGUAGE_PROFILES)
_IN = ", ".join(f"'{lang}'" for lang in _LANGS)


@register("language_tags_by_grams", f"""WITH {F5_SQL},
nd AS (SELECT doc_id, lang, replace(replace(text, chr(160), ' '), chr(8203), ' ') AS text FROM f5),
tk AS (SELECT doc_id, unnest({_TOKS.format(x='text')}) AS w FROM nd),
g AS (SELECT doc_id, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM tk),
pick AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r
         FROM nd WHERE lang IN ({_IN})) WHERE r <= {tx.PROFILE_DOCUMENTS}),
cnt AS (SELECT lang, gram, count(*) AS c FROM g JOIN pick USING (doc_id) GROUP BY ALL),
tot AS (SELECT l.lang, coalesce(sum(c), 0) AS t FROM (SELECT unnest([{_IN}]) AS lang) l LEFT JOIN cnt USING (lang) GROUP BY ALL),
top AS (SELECT gram FROM cnt GROUP BY gram ORDER BY sum(c) DESC, gram LIMIT {tx.PROFILE_GRAMS}),
prof AS (SELECT top.gram, tot.lang, CAST(floor(1000 * ln((coalesce(c, 0) + 1.0) / CAST(t + {tx.PROFILE_GRAMS} AS DOUBLE))) AS BIGINT) AS w
         FROM top CROSS JOIN tot LEFT JOIN cnt ON cnt.gram = top.gram AND cnt.lang = tot.lang),
sc AS (SELECT doc_id, p.lang, sum(w) AS s, count(*) AS n FROM g JOIN prof p USING (gram) GROUP BY ALL),
best AS (SELECT doc_id, lang AS detected, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM sc) WHERE r = 1)
SELECT doc_id, lang AS given, detected, CAST(n AS BIGINT) AS hits, coalesce(lang = detected, false) AS agrees FROM nd LEFT JOIN best USING (doc_id)""")
def q_language_tags_by_grams(spark, sf_dir):
    """X10 by character n-grams: profiles learnt from at most 100 labelled documents a language, every document tagged."""
    d = tx.normalise_documents(fx.f5_documents(spark, sf_dir))
    tags = tx.detect_language_by_grams(d, "doc_id", tx.learn_language_profiles(d, "doc_id"))
    return (d.select("doc_id", F.col("lang").alias("given")).join(tags, "doc_id", "left")
            .select("doc_id", "given", "detected", F.col("hits").cast("bigint").alias("hits"),
                    F.coalesce(F.col("given") == F.col("detected"), F.lit(False)).alias("agrees")))


@register("translation_work_list", f"""{LANG_SQL}
SELECT md5(text) AS text_md5, detected AS lang, CAST(count(*) AS BIGINT) AS n_docs
FROM tags WHERE detected <> 'en' GROUP BY ALL""")
def q_translation_work_list(spark, sf_dir):
    d = tx.normalise_documents(fx.f5_documents(spark, sf_dir))
    tags = tx.detect_language(d, "doc_id")
    routed = d.join(tags.select("doc_id", "detected"), "doc_id")
    return tx.translation_work_list(routed, "text", "detected", None).select(
        "text_md5", "lang", F.col("n_docs").cast("bigint").alias("n_docs"))


_MEMORY_SQL = """mem AS (SELECT DISTINCT md5(text) AS text_md5, 'T:' || left(text, 40) AS translated FROM documents
         WHERE lang <> 'en' AND doc_id % 3 = 0)"""


def _memory(spark, sf_dir):
    """A translation memory: every third foreign document's text is known, by a rule."""
    d = table(spark, sf_dir, "documents").filter("lang <> 'en' and doc_id % 3 = 0")
    return d.select(F.md5("text").alias("text_md5"), F.concat(F.lit("T:"), F.substring("text", 1, 40)).alias("translated")).distinct()


@register("translation_left_to_do", f"""WITH {_MEMORY_SQL}
SELECT md5(text) AS text_md5, lang, CAST(count(*) AS BIGINT) AS n_docs FROM documents
WHERE lang <> 'en' AND md5(text) NOT IN (SELECT text_md5 FROM mem) GROUP BY ALL""")
def q_translation_left_to_do(spark, sf_dir):
    """X11: the work list against a memory (anti join)."""
    w = tx.translation_work_list(table(spark, sf_dir, "documents"), "text", "lang", _memory(spark, sf_dir))
    return w.select("text_md5", "lang", F.col("n_docs").cast("bigint").alias("n_docs"))


@register("translated_documents", f"""WITH {_MEMORY_SQL}
SELECT doc_id, md5(coalesce(translated, text)) AS text_md5, translated IS NOT NULL AS from_memory
FROM documents d LEFT JOIN mem ON mem.text_md5 = md5(d.text)""")
def q_translated_documents(spark, sf_dir):
    """X11: texts replaced from the memory, the others as they are."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    t = tx.apply_translations(d, "text", _memory(spark, sf_dir))
    return t.select("doc_id", F.md5("text").alias("text_md5"), (F.col("text") != F.col("before")).alias("from_memory"))


# Fixed rule list for the redaction query (configuration, applied in order).
REDACTION_RULES = [("the", "[A]"), ("[A] and", "[B]"), ("de", "[C]"), ("la", "[D]"), ("und", "[E]")]


def _redact_sql() -> str:
    cur = "text"
    hits = []
    for i, (old, new) in enumerate(REDACTION_RULES):
        hits.append(f"CAST((length({cur}) - length(replace({cur}, '{old}', ''))) / {len(old)} AS BIGINT) AS hits_{i}")
        cur = f"replace({cur}, '{old}', '{new}')"
    return f"SELECT doc_id, md5({cur}) AS redacted_md5, {', '.join(hits)} FROM f5"


@register("redacted_documents", f"""WITH {F5_SQL}
{_redact_sql()}""")
def q_redacted_documents(spark, sf_dir):
    r = tx.redact(fx.f5_documents(spark, sf_dir), "text", REDACTION_RULES)
    return r.select("doc_id", F.md5("redacted").alias("redacted_md5"),
                    *[f"hits_{i}" for i in range(len(REDACTION_RULES))])


@register("redaction_hits", f"""WITH {F5_SQL}, r AS ({_redact_sql()})
SELECT {", ".join(f"CAST(sum(hits_{i}) AS BIGINT) AS hits_{i}" for i in range(len(REDACTION_RULES)))} FROM r""")
def q_redaction_hits(spark, sf_dir):
    r = tx.redact(fx.f5_documents(spark, sf_dir), "text", REDACTION_RULES)
    return r.agg(*[F.sum(f"hits_{i}").cast("bigint").alias(f"hits_{i}") for i in range(len(REDACTION_RULES))])


@register("links_removed", r"""
SELECT page_id, CAST(length(h) AS BIGINT) AS n_chars, md5(h) AS html_md5,
       CAST((length(h) - length(replace(lower(h), '<a ', ''))) // 3 AS BIGINT) AS anchors_left
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<a\b[^>]*>(.*?)</a\s*>', '\1', 'g'),
                                     '(?i)\b(?:https?://|www\.)[^\s<>"'']+', '', 'g') AS h FROM pages)""")
def q_links_removed(spark, sf_dir):
    p = tx.strip_links(table(spark, sf_dir, "pages"))
    h = F.col("html")
    return p.select("page_id", F.length(h).cast("bigint").alias("n_chars"), F.md5(h).alias("html_md5"),
                    ((F.length(h) - F.length(F.replace(F.lower(h), F.lit("<a "), F.lit("")))) / 3)
                    .cast("bigint").alias("anchors_left"))


_PSEUDO_SQL = """
fn AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS fi FROM (SELECT DISTINCT upper(left(lower(n_name), 1)) || substr(lower(n_name), 2) AS f FROM nation
        WHERE strpos(n_name, ' ') = 0)),
sn AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS si FROM (SELECT DISTINCT 'Size' || p_size AS s FROM part WHERE p_size <= 3)),
ns AS (SELECT (SELECT count(*) FROM sn) AS n, (SELECT count(*) FROM fn) AS f),
ids AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier),
named AS (
  SELECT ids.s_suppkey, fn.f || ' ' || sn.s || CASE WHEN r >= ns.n * ns.f THEN '-' || (r // (ns.n * ns.f) + 1) ELSE '' END AS name
  FROM ids, ns JOIN fn ON fn.fi = (ids.r // ns.n) % ns.f JOIN sn ON sn.si = ids.r % ns.n
)"""


def _pseudonyms(spark, sf_dir):
    """F8: forenames from ``nation`` (capitalised), surnames ``Size<p_size>``
    up to 3 from ``part``, ids from ``supplier``: a pool so small that names go round."""
    nation = table(spark, sf_dir, "nation")
    fn = nation.select(F.concat(F.upper(F.substring(F.lower("n_name"), 1, 1)),
                                F.substring(F.lower("n_name"), 2, 1000)).alias("forename"))
    sn = table(spark, sf_dir, "part").filter("p_size <= 3").select(F.concat(F.lit("Size"), F.col("p_size").cast("string")).alias("surname"))
    return tx.pseudonyms(table(spark, sf_dir, "supplier"), "s_suppkey", fn, sn)


@register("pseudonyms", f"""WITH {_PSEUDO_SQL}
SELECT s_suppkey, name FROM named""")
def q_pseudonyms(spark, sf_dir):
    return _pseudonyms(spark, sf_dir)


@register("name_checks", f"""WITH {_PSEUDO_SQL}
SELECT s_suppkey AS id, name, coalesce(len(string_split(name, ' ')) = 2 AND name = trim(name)
       AND strpos(name, '  ') = 0 AND length(name) >= 3, false) AS valid_name FROM named
UNION ALL
SELECT c_custkey AS id, c_name AS name, coalesce(len(string_split(c_name, ' ')) = 2 AND c_name = trim(c_name)
       AND strpos(c_name, '  ') = 0 AND length(c_name) >= 3, false) AS valid_name FROM customer""")
def q_name_checks(spark, sf_dir):
    names = _pseudonyms(spark, sf_dir).select(F.col("s_suppkey").alias("id"), "name")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tx.name_checks(names.unionByName(cust))


def _clean_sql(x: str) -> str:
    return f"replace(replace({x}, chr(160), ' '), chr(8203), ' ')"


@register("document_texts", f"""WITH prof(lang, lang_rank, token) AS (VALUES {_profile_sql()}),
doc AS (SELECT conv_id, {_clean_sql(f"string_agg({strip_sql('text')}, chr(10) ORDER BY turn)")} AS text FROM conversations GROUP BY conv_id),
tk AS (SELECT conv_id, unnest({_TOKS.format(x='text')}) AS token FROM doc),
h AS (SELECT conv_id, lang, lang_rank, count(*) AS hits FROM tk JOIN prof USING (token) GROUP BY ALL),
best AS (SELECT conv_id, lang AS detected FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, lang_rank) AS rn FROM h) WHERE rn = 1),
mem AS (SELECT DISTINCT text, 'T:' || chr(160) || left(text, 40) AS translated FROM doc WHERE conv_id % 3 = 0),
out AS (SELECT conv_id, detected, {_clean_sql("CASE WHEN detected <> 'en' THEN coalesce(translated, doc.text) ELSE doc.text END")} AS text
        FROM doc LEFT JOIN best USING (conv_id) LEFT JOIN mem ON mem.text = doc.text)
SELECT conv_id, detected, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM out""")
def q_document_texts(spark, sf_dir):
    """X9 as a chain: turns as pages, replacements, language, a memory that knows every third text (also English ones, which
    must stay), replacements once more."""
    conv = table(spark, sf_dir, "conversations")
    known = tx.normalise_documents(tx.assemble_pages(conv.where("conv_id % 3 = 0"), ["conv_id"], "turn", "text"))
    memory = known.select(F.md5("text").alias("text_md5"), F.concat(F.lit("T:" + fx.NBSP), F.substring("text", 1, 40)).alias("translated"))
    out = tx.document_texts(conv, ["conv_id"], "turn", "text", memory)
    return out.select("conv_id", "detected", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))
