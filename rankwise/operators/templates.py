"""Request texts: placeholder substitution (X12), the four builders (X13),
sample shapes (X14).

Substitution goes like a chain of ``replace`` in a fixed order:
static placeholders first, then the dynamic ones.  A replaced value may
itself contain a later placeholder, which is then replaced too - exactly
the sequential semantics, kept by construction.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwise.functions.columns import _WS_CLASS, strip_unicode
from rankwise.schemas import KIND_MANDATORY, KIND_OPTIONAL, MAX_SCORE, MIN_SCORE, REQUIREMENT_DEFINITIONS, \
    REQUIREMENT_TYPES

# Own template texts (the wording is ours; the placeholders are the contract).
TEMPLATES = {
    "prettify": "Reformat the text below for readability without changing its content.\n\n{TEXT}",
    "extract": ("Extract the requirements of this job description as JSON shaped like {EMPTY_REQUIREMENTS}. "
                "Each item looks like {SAMPLE_REQUIREMENT}; its type is \"{REQUIREMENT_TYPE_MANDATORY}\" or "
                "\"{REQUIREMENT_TYPE_OPTIONAL}\". Type meanings: {REQUIREMENT_TYPE_DEFINITIONS}.\n\n{JOB_TEXT}"),
    "match": ("Rate how well the CV meets the requirement \"{REQUIREMENT_SPECIFICATION}\" of type "
              "\"{REQUIREMENT_TYPE_NAME}\" ({REQUIREMENT_TYPE_DEFINITION}) from {MINIMUM_SCORE_VALUE} to "
              "{MAXIMUM_SCORE_VALUE}; answer with {EMPTY_SCORE}.\n\n{CV_TEXT}"),
    "decide": ("Given these requirement matches {REQUIREMENT_MATCHES}, scored from {MINIMUM_SCORE_VALUE} to "
               "{MAXIMUM_SCORE_VALUE}, decide whether the candidate should proceed; answer with "
               "{EMPTY_PROMISING_RESULT}."),
}

# Placeholder order (static, then dynamic).
STATIC_ORDER = ["EMPTY_SCORE", "EMPTY_PROMISING_RESULT", "EMPTY_REQUIREMENTS", "SAMPLE_REQUIREMENT",
                "MINIMUM_SCORE_VALUE", "MAXIMUM_SCORE_VALUE", "REQUIREMENT_TYPE_OPTIONAL",
                "REQUIREMENT_TYPE_MANDATORY", "REQUIREMENT_TYPE_DEFINITIONS"]
DYNAMIC_ORDER = ["TEXT", "JOB_TEXT", "CV_TEXT", "REQUIREMENT_SPECIFICATION", "REQUIREMENT_TYPE_NAME",
                 "REQUIREMENT_TYPE_DEFINITION", "REQUIREMENT_MATCHES"]


def sample_shapes(lo: int = MIN_SCORE, types: list[str] | None = None) -> dict[str, str]:
    """The empty answer shapes as compact JSON (non-ASCII kept)."""
    types = types or [t for t, _ in REQUIREMENT_TYPES]
    dump = lambda o: json.dumps(o, ensure_ascii=False, separators=(",", ":"))
    return {
        "EMPTY_SCORE": dump({"value": lo, "explanation": "explanation of the value"}),
        "EMPTY_PROMISING_RESULT": dump({"promising": False, "explanation": "explanation of the decision"}),
        "EMPTY_REQUIREMENTS": dump({t: [] for t in types}),
        "SAMPLE_REQUIREMENT": dump({"type": KIND_MANDATORY, "specification": "what is required"}),
    }


def static_values(lo: int = MIN_SCORE, hi: int = MAX_SCORE) -> dict[str, str]:
    vals = sample_shapes(lo)
    vals.update({
        "MINIMUM_SCORE_VALUE": str(lo), "MAXIMUM_SCORE_VALUE": str(hi),
        "REQUIREMENT_TYPE_OPTIONAL": KIND_OPTIONAL, "REQUIREMENT_TYPE_MANDATORY": KIND_MANDATORY,
        "REQUIREMENT_TYPE_DEFINITIONS": json.dumps(REQUIREMENT_DEFINITIONS, ensure_ascii=False,
                                                   separators=(",", ":")),
    })
    return vals


def _whole_pieces(template: str, names: list[str]) -> list[str] | None:
    """The template cut at its dynamic placeholders: texts at even places, names at odd ones; None if a text ends in the
    beginning of a placeholder, which a value could complete."""
    pieces = re.split("{(" + "|".join(names) + ")}", template) if names else [template]
    begun = ["{" + name + "}" for name in names]
    ends = [text[text.rfind("{"):] for text in pieces[::2] if "{" in text]
    return None if any(b.startswith(end) for end in ends for b in begun) else pieces


def _stripped(value: Column) -> Column:
    """``strip_unicode``, by a pattern only where there is something to strip."""
    ends = F.concat(F.substring(value, 1, 1), F.substring(value, -1, 1))
    return F.coalesce(F.when(ends.rlike(_WS_CLASS), strip_unicode(value)).otherwise(value), F.lit(""))


def render(template: str | Column, dynamic: dict[str, Column | str], static: dict[str, str] | None = None) -> Column:
    """Replace ``{NAME}`` placeholders, static ones first and then the
    dynamic ones, each value stripped.  Values without a brace can hold no
    placeholder: they are set between the template's pieces in one go; the
    others go through the chain."""
    static = static if static is not None else static_values()
    known = {name: static[name].strip() for name in STATIC_ORDER if name in static}
    if isinstance(template, str):
        for name, value in known.items():
            template = template.replace("{" + name + "}", value)
        out = F.lit(template)
    else:
        out = template
        for name, value in known.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.lit(value))
    values = {name: _stripped(F.lit(dynamic[name]) if isinstance(dynamic[name], str) else dynamic[name])
              for name in DYNAMIC_ORDER if name in dynamic}
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    pieces = _whole_pieces(template, list(values)) if isinstance(template, str) else None
    if pieces is None or len(pieces) == 1:
        return out
    plain = functools.reduce(lambda a, b: a & b, [~F.contains(v, F.lit("{")) for v in values.values()])
    return F.when(plain, F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])).otherwise(out)


def match_request(cv_text: Column, specification: Column, type_name: Column, definition: Column) -> Column:
    """Request to score one requirement against one CV."""
    return render(TEMPLATES["match"], {"CV_TEXT": cv_text, "REQUIREMENT_SPECIFICATION": specification,
                                       "REQUIREMENT_TYPE_NAME": type_name, "REQUIREMENT_TYPE_DEFINITION": definition})


def extract_request(job_text: Column) -> Column:
    return render(TEMPLATES["extract"], {"JOB_TEXT": job_text})


def prettify_request(text: Column) -> Column:
    return render(TEMPLATES["prettify"], {"TEXT": text})


def decide_request(matches_json: Column) -> Column:
    return render(TEMPLATES["decide"], {"REQUIREMENT_MATCHES": matches_json})
