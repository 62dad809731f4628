"""License scan: ordered signature rules with keyword gates (native).

A text is lower-cased (A-Z), every run of other ASCII characters becomes one
space, and the scan works on the resulting words.  A rule is a hand-written
regular expression over those words with a keyword that must occur before
the expression is tried, a priority and a confidence.  Of overlapping
detections, one that lies inside another of the same or higher priority is
suppressed.

Everything is a column expression over one row: no shuffle, no Python.
Texts without any keyword (nearly all) never reach the regular expressions.

Defined results: a null or empty text has no words and no labels.  Repeated
rows are scanned one by one.  Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwise.llm.common import lower_ascii, text_of

#: Everything in ASCII that is not a digit or a letter separates words (A-Z are lower-cased where it matters).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over space-joined lower-case words and matches whole words, ``keyword`` among them."""

    label: str
    keyword: str
    pattern: str
    priority: int  # 1: a name or a hint, 2: a phrase, 3: a notice or grant
    confidence: float


@dataclass(frozen=True)
class Phrase:
    words: str
    label: str


#: Fixed values of the contract.
BASE_PHRASES = (Phrase("cc by", "cc-by"), Phrase("general public license", "gpl"),
                Phrase("all rights reserved", "reserved"))

_VERSION = r"(?: (?:version|v|ver))? "
# name words, label stem, versions (first is the default of the bare name)
_FAMILIES = (
    ("apache", r"apache", "apache", ("2 0", "1 1", "1 0")),
    ("mozilla", r"mozilla public", "mpl", ("2 0", "1 1", "1 0")),
    ("eclipse", r"eclipse public", "epl", ("2 0", "1 0")),
    ("academic", r"academic free", "afl", ("3 0", "2 1", "2 0")),
    ("artistic", r"artistic", "artistic", ("2 0", "1 0")),
    ("european", r"european union public", "eupl", ("1 2", "1 1")),
    ("boost", r"boost software", "bsl", ("1 0",)),
    ("lesser", r"lesser general public", "lgpl", ("3 0", "2 1", "3", "2")),
    ("affero", r"affero general public", "agpl", ("3 0", "3", "1 0")),
    ("documentation", r"free documentation", "gfdl", ("1 3", "1 2", "1 1")),
    ("public", r"general public", "gpl", ("3 0", "2 0", "3", "2", "1")),
    ("open", r"open software", "osl", ("3 0", "2 1", "1 0")),
    ("cecill", r"cecill(?: free software)?", "cecill", ("2 1", "2 0")),
    ("font", r"(?:sil )?open font", "ofl", ("1 1", "1 0")),
)
_GRANTS = r"(?:licensed|released|distributed|available|published|redistributed) under (?:the )?(?:terms of )?(?:the )?"


def _family_rules() -> list[Rule]:
    rules = []
    for keyword, name, stem, versions in _FAMILIES:
        lic = rf"{name} licen[sc]e"
        rules.append(Rule(stem, keyword, lic, 1, 0.7))
        rules.append(Rule(stem, keyword, rf"{_GRANTS}(?:gnu )?{lic}", 3, 0.9))
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            rules.append(Rule(label, keyword, rf"(?:gnu )?{lic}{_VERSION}{v}", 2, 0.95))
            rules.append(Rule(label, keyword, rf"{_GRANTS}(?:gnu )?{lic}{_VERSION}{v}", 3, 1.0))
            rules.append(Rule(label, stem, rf"{stem}(?: v)? {v}", 2, 0.8))
    return rules


def _creative_commons_rules() -> list[Rule]:
    long_names = {"by": "attribution", "nc": "noncommercial", "nd": "no ?derivatives", "sa": "share ?alike"}
    rules = [Rule("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 2, 0.9),
             Rule("cc0", "creative", r"creative commons zero", 2, 0.9),
             Rule("cc", "creative", r"creative commons(?: licen[sc]e)?", 1, 0.6)]
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label, short = "cc-" + "-".join(parts), "cc " + " ".join(parts)
        named = " ".join(long_names[p] for p in parts).replace("noncommercial", "non ?commercial")
        rules.append(Rule(label, "cc", short, 1 + (len(parts) > 1), 0.8))
        rules.append(Rule(label, "creative", rf"creative commons {named}", 2, 0.95))
        for v in ("4 0", "3 0", "2 5", "2 0", "1 0"):
            rules.append(Rule(f"{label}-{v.replace(' ', '.')}", "cc", f"{short} {v}", 2, 0.95))
            rules.append(Rule(f"{label}-{v.replace(' ', '.')}", "creative",
                              rf"creative commons {named} {v}", 3, 1.0))
    return rules


_SINGLE_RULES = [
    Rule("mit", "permission", r"permission is hereby granted free of charge to any person", 3, 1.0),
    Rule("mit", "mit", r"(?:the )?mit licen[sc]e", 2, 0.9),
    Rule("mit", "mit", rf"{_GRANTS}mit(?: licen[sc]e)?", 3, 1.0),
    Rule("x11", "x11", r"x11 licen[sc]e", 2, 0.9),
    Rule("isc", "permission", r"permission to use copy modify and(?: or)? distribute this software", 3, 1.0),
    Rule("isc", "isc", r"isc licen[sc]e", 2, 0.9),
    Rule("bsd", "bsd", r"bsd licen[sc]e", 1, 0.7),
    Rule("bsd", "redistribution", r"redistribution and use in source and binary forms", 3, 0.9),
    Rule("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?", 2, 0.95),
    Rule("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?", 2, 0.95),
    Rule("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", 2, 0.95),
    Rule("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", 2, 0.9),
    Rule("unlicense", "unlicense", r"(?:the )?unlicense", 2, 0.9),
    Rule("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 3, 1.0),
    Rule("wtfpl", "wtfpl", r"wtfpl", 2, 0.9),
    Rule("public-domain", "domain", r"(?:in|into|to) the public domain", 2, 0.8),
    Rule("public-domain", "domain", r"public domain", 1, 0.6),
    Rule("python", "python", r"python software foundation licen[sc]e", 2, 0.9),
    Rule("ms-pl", "microsoft", r"microsoft public licen[sc]e", 2, 0.9),
    Rule("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", 2, 0.9),
    Rule("odbl", "database", r"open database licen[sc]e", 2, 0.9),
    Rule("gpl", "gpl", r"gnu gpl", 1, 0.7),
    Rule("reserved", "reserved", r"all rights (?:are )?reserved", 2, 0.9),
    Rule("reserved", "reserved", r"alle rechte vorbehalten", 2, 0.9),
    Rule("reserved", "vorbehalten", r"alle rechte vorbehalten", 2, 0.9),
    Rule("reserved", "droits", r"tous droits réservés", 2, 0.9),
    Rule("reserved", "derechos", r"todos los derechos reservados", 2, 0.9),
    Rule("proprietary", "proprietary", r"proprietary and confidential", 2, 0.9),
    Rule("proprietary", "permission", r"without (?:the )?(?:prior )?(?:written )?permission of", 2, 0.7),
    Rule("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 2, 0.7),
    Rule("copyright", "copyright", r"(?:protected by|under) copyright", 1, 0.5),
]

#: In this order; the first of equal detections stays.
RULES: tuple[Rule, ...] = tuple(_family_rules() + _creative_commons_rules() + _SINGLE_RULES)


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_table(rules: Sequence[Rule]) -> str:
    """Array of ``(keyword, rules)``, so that a keyword is looked for once."""
    groups: dict[str, list[str]] = {}
    for n, r in enumerate(rules):
        groups.setdefault(r.keyword, []).append(
            f"struct({n} as id, {_quote(r.label)} as label, {_quote(rf'(?<![^ ])(?:{r.pattern})(?![^ ])')} as pattern, "
            f"{r.priority} as priority, cast({r.confidence} as double) as confidence)")
    return "array(" + ", ".join(f"struct({_quote(f' {k} ')} as keyword, array({', '.join(g)}) as rules)"
                                for k, g in groups.items()) + ")"


def _spaces(x: str) -> str:
    return f"(octet_length({x}) - octet_length(replace({x}, ' ', '')))"


def _detections(rules: Sequence[Rule]) -> Column:
    """``words`` -> array of ``(start, end, priority, id, label, confidence)``, word positions.

    The pieces between matches give the positions: a match starts after as
    many words as there are spaces before it.
    """
    found = f"""
      flatten(transform(flatten(transform(filter({_rule_table(rules)},
          k -> contains(concat(' ', words, ' '), k.keyword)), k -> k.rules)), r ->
        aggregate(
          zip_with(regexp_extract_all(words, r.pattern, 0), split(words, r.pattern),
                   (m, p) -> struct(m, p)),
          struct(cast(0 as bigint) as at, cast(array() as array<struct<start: bigint, end: bigint, priority: int,
                 id: int, label: string, confidence: double>>) as spans),
          (acc, x) -> if(x.m is null, acc, struct(
            acc.at + {_spaces('x.p')} + {_spaces('x.m')} as at,
            concat(acc.spans, array(struct(
              acc.at + {_spaces('x.p')} as start, acc.at + {_spaces('x.p')} + {_spaces('x.m')} + 1 as end,
              r.priority as priority, r.id as id, r.label as label, r.confidence as confidence))) as spans)),
          acc -> acc.spans)))"""
    return F.expr(found)


#: Start ascending, end and priority descending: whatever contains a span comes before it.
_ORDER = ("(a, b) -> case when a.start <> b.start then if(a.start < b.start, -1, 1) "
          "when a.end <> b.end then if(a.end > b.end, -1, 1) "
          "when a.priority <> b.priority then if(a.priority > b.priority, -1, 1) "
          "when a.id <> b.id then if(a.id < b.id, -1, 1) else 0 end")


def _suppressed() -> Column:
    """Detections that lie in no other of the same or higher priority (one ordered pass)."""
    return F.expr(f"""
      aggregate(array_sort(detections, {_ORDER}),
        struct(cast(array(-1, -1, -1) as array<bigint>) as reach, slice(detections, 1, 0) as kept),
        (acc, x) -> if(acc.reach[x.priority - 1] >= x.end, acc, struct(
          transform(acc.reach, (e, i) -> if(i < x.priority, greatest(e, x.end), e)) as reach,
          concat(acc.kept, array(x)) as kept)),
        acc -> acc.kept)""")


def _phrase_places(phrase: Phrase) -> Column:
    """Every word position at which the phrase's words stand."""
    parts = phrase.words.split(" ")
    test = " and ".join(f"get(w, i + {k}) = {_quote(p)}" for k, p in enumerate(parts))
    places = (f"transform(array(split(words, ' ')), w -> "
              f"filter(transform(w, (x, i) -> cast(i as bigint)), i -> {test}))[0]".replace("get(w, i", "get(w, cast(i as int)"))
    return F.expr(f"if(contains(concat(' ', words, ' '), {_quote(' ' + phrase.words + ' ')}), {places}, "
                  f"cast(array() as array<bigint>))")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         rules: Sequence[Rule] = RULES, phrases: Sequence[Phrase] = BASE_PHRASES) -> DataFrame:
    """License labels of whole texts.

    Returns ``id_col``, ``n_words``, ``places`` (phrase places, as arrays by
    label), ``detections`` (surviving rule spans) and ``score``: the chance
    that some surviving detection is right, taking confidences as
    independent; with phrases only 0.5; else 0.
    """
    # one look at each word decides whether a text is lower-cased and scanned at all
    starts = sorted({r.keyword for r in rules} | {p.words for p in phrases})
    gate = f"(?i)(?:^| )(?=[{''.join(sorted({k[0] for k in starts}))}])(?:{'|'.join(starts)})(?: |$)"
    words = F.trim(F.regexp_replace(text_of(text_col), SEPARATORS, " "))
    out = docs.select(F.col(id_col), words.alias("all_words"))
    out = out.select(id_col, F.expr(f"if(all_words = '', 0, {_spaces('all_words')} + 1)").cast("bigint").alias("n_words"),
                     F.when(F.col("all_words").rlike(gate), lower_ascii(F.col("all_words"))).alias("words"))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, priority: int, id: int, "
                  "label: string, confidence: double>>)")
    nowhere = F.expr("cast(array() as array<bigint>)")
    out = out.select(
        id_col, "n_words",
        F.array(*[F.struct(F.lit(p.label).alias("label"),
                           F.when(F.col("words").isNotNull(), _phrase_places(p)).otherwise(nowhere).alias("at"))
                  for p in phrases]).alias("places"),
        F.when(F.col("words").isNotNull(), _detections(rules)).otherwise(none).alias("detections"))
    out = out.withColumn("detections", F.when(F.size("detections") > 1, _suppressed()).otherwise(F.col("detections")))
    missed = F.expr("aggregate(transform(array_distinct(transform(detections, d -> struct(d.label as l, "
                    "d.confidence as c))), x -> 1D - x.c), 1D, (a, x) -> a * x)")
    score = F.when(F.size("detections") > 0, F.lit(1.0) - missed).when(
        F.expr("exists(places, p -> size(p.at) > 0)"), F.lit(0.5)).otherwise(F.lit(0.0))
    return out.withColumn("score", score)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``scan``'s result."""
    at = F.expr("flatten(transform(places, p -> p.at))")
    base = F.expr("transform(filter(places, p -> size(p.at) > 0), p -> p.label)")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        F.col(id_col), "n_words", F.size(at).cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.array_union(base, F.expr("transform(detections, d -> d.label)"))).alias("labels"), "score")
