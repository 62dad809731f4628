"""Column -> Column helpers.  All are built-in expressions (codegen, no UDF)."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default replacement pairs applied to extracted text
# (no-break space and zero-width space become a plain blank).
DEFAULT_TEXT_REPLACEMENTS: list[tuple[str, str]] = [("\u00a0", " "), ("\u200b", " ")]


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, lo, hi) -> Column:
    """``min(hi, max(lo, x))`` for ints and floats."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col_(c)))


# Characters Python's ``str.strip`` removes (Unicode white space plus the
# four ASCII information separators), as a Java regex class.
_WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_unicode(c: Column | str) -> Column:
    """Trim all Unicode white space at both ends (Spark ``trim`` strips blanks only)."""
    return F.regexp_replace(col_(c), f"^{_WS_CLASS}+|{_WS_CLASS}+$", "")


def replace_chain(c: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Ordered literal replacements, each applied to the result of the previous one."""
    return functools.reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), list(pairs), col_(c))


def ballot_timestamp(c: Column | str) -> Column:
    """``2025/05/02 7:15:09 AM GMT+1`` -> timestamp (session zone UTC)."""
    c = col_(c)
    sign = F.regexp_extract(c, r"GMT([+-])(\d{1,2})$", 1)
    hours = F.lpad(F.regexp_extract(c, r"GMT([+-])(\d{1,2})$", 2), 2, "0")
    base = F.regexp_replace(c, r"\s*GMT[+-]\d{1,2}$", "")
    return F.to_timestamp(F.concat(base, F.lit(" "), sign, hours, F.lit(":00")), "yyyy/MM/dd h:mm:ss a XXX")


def name_set(c: Column | str, sep: str = ";") -> Column:
    """``a;b;a`` -> distinct array (duplicates in a list collapse)."""
    return F.array_distinct(F.split(col_(c), sep))


def label_suffix(c: Column | str, drop_words: int = 2) -> Column:
    """Drop the first words of a header label (``Place of A B`` -> ``A B``)."""
    parts = F.split(col_(c), " ")
    return F.array_join(F.slice(parts, drop_words + 1, F.greatest(F.size(parts) - drop_words, F.lit(0))), " ")


def tau_to_pair_distance(tau: Column | str, n: Column | str) -> Column:
    """``(1 - tau) / 2 * C(n, 2)`` truncated, with guard against float noise."""
    pairs = col_(n) * (col_(n) - 1) / 2
    return F.floor((F.lit(1.0) - col_(tau)) / 2 * pairs + F.lit(1e-9)).cast("bigint")


def elapsed_seconds_ceil(start: Column | str, stop: Column | str) -> Column:
    """Elapsed seconds between two timestamps, rounded up."""
    # exact for TIMESTAMP and TIMESTAMP_NTZ alike, no time-zone conversion
    micros = F.timestamp_diff("MICROSECOND", col_(start), col_(stop))
    return F.ceil(micros / F.lit(1_000_000)).cast("bigint")


def is_two_part_name(c: Column | str) -> Column:
    """P5: exactly two blank-separated non-empty parts, no stray blanks."""
    c = col_(c)
    return (F.size(F.split(c, " ")) == 2) & (c == F.trim(c)) & ~c.contains("  ") & (F.length(c) >= 3)


def round6(c: Column | str) -> Column:
    """Round to 6 decimals; a negative zero becomes 0.0 (stable hashes)."""
    r = F.round(col_(c), 6)
    return F.when(r == 0, F.abs(r)).otherwise(r)
