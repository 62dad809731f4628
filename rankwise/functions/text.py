"""Text helpers as Column expressions (tokens, n-grams, links, redaction)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwise.functions.columns import col_

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased letter/digit runs of the whole text (no empty tokens)."""
    return F.array_remove(F.split(F.lower(col_(text)), TOKEN_SPLIT), "")


def ngrams(toks: Column, max_n: int = 3) -> Column:
    """All 1..max_n-grams of a token array, joined by a blank (with repeats).

    Built with ``zip_with`` over shifted copies, so the work is linear in the
    number of tokens (no per-position slicing inside a lambda)."""
    parts = [toks]
    grams = toks
    for k in range(2, max_n + 1):
        shifted = F.slice(toks, k, F.greatest(F.size(toks) - k + 1, F.lit(0)))
        grams = F.zip_with(grams, shifted, lambda g, t: F.concat(g, F.lit(" "), t))
        parts.append(F.filter(grams, lambda g: g.isNotNull()))
    return F.flatten(F.array(*parts))


# Anchor elements: keep the visible text, drop the tag.
ANCHOR_RE = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
URL_RE = r"(?i)\b(?:https?://|www\.)[^\s<>\"']+"


def remove_links(html: Column | str) -> Column:
    """Anchors replaced by their inner text, bare URLs removed."""
    no_anchor = F.regexp_replace(col_(html), ANCHOR_RE, "$1")
    return F.regexp_replace(no_anchor, URL_RE, "")
