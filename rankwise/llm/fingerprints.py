"""Document fingerprints: a homomorphic multiset hash of paragraphs (native).

A document is the multiset of its non-blank lines (paragraphs).  Each
paragraph hashes to a wide vector; a document's vector is the sum of its
paragraphs' vectors, each lane modulo a power of two.  The order of
paragraphs doesn't matter, and adding or taking away a paragraph is adding or
subtracting its vector (``combine``).  The vector has two parts:

* ``whole``: four dense lanes modulo 2^62 hashed from the entire paragraph;
  equal lanes mean equal multisets up to hash collisions;
* ``lanes``: a sparse row of lanes modulo 2^50 to which each part of the
  paragraph adds in one lane; this gives the likeness.  A part ends with a
  sentence or clause, after a word whose last two characters are of a fixed class (so its
  content chooses, wherever it stands), or after ``WORDS`` words.  One hash of the
  part puts it on one of 16 levels, which take 1/2, 1/4, ... of all parts, and
  there in one of 512 lanes.  A part adds its hash and, in the low bits, one, so
  that a lane with a single part tells how often it occurs.  Lane and sum are
  packed into one long.

Likeness is the parts shared by two documents, with their counts, over the
parts of both, taken from the first level on that isn't crowded, so that it
does not depend on length.

All of it is column expressions in one row, linear in the text but for a sort
of longs.  Defined results: a null or blank text has the zero vector; repeated
rows get equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwise.llm.common import text_of

WHOLE_LANES = 4
WHOLE_MASK = (1 << 62) - 1
LEVELS = 16
LANES = 512
#: A lane's sum: hashes of 26 bits above the number of parts (right up to 2^24 - 1 of them).
COUNT_BITS, HASH_BITS = 24, 26
SUM_BITS = COUNT_BITS + HASH_BITS
SUM_MASK = (1 << SUM_BITS) - 1
LEVEL_SHIFT = SUM_BITS + LANES.bit_length() - 1
#: Lanes in use from which on a level is too crowded to compare.
CROWDED = 64
#: Most words of a part; runs of more than ``LONG`` characters without a blank are cut after a character of the class, at ``RUN`` at the latest.
WORDS, LONG, RUN = 6, 256, 64
#: Every third Latin letter or digit and a third of some other alphabets: one word in nine or so ends with two of them.
_CLASS = "".join(chr(c) for c in range(0x30, 0x100) if c % 3 == 0 and chr(c).isalnum()) + "α-θа-и"
_PART = rf"(?:\S++(?<![.!?,]|[{_CLASS}][{_CLASS}])\s++){{0,{WORDS - 1}}}+\S++"
_RUN = rf"(?s)[^{_CLASS}]{{0,{RUN - 1}}}+[{_CLASS}]|.{{1,{RUN}}}"
#: Ranges of ids, when neighbours are looked up: at most so many, and of so many rows at least on average.
RANGES = 4096
ROWS_PER_RANGE = 512


def _parts(paras: Column, text: Column) -> Column:
    words = F.flatten(F.transform(paras, lambda p: F.regexp_extract_all(p, F.lit(_PART), F.lit(0))))
    cut = F.flatten(F.transform(words, lambda s: F.when(F.char_length(s) > LONG, F.regexp_extract_all(s, F.lit(_RUN), F.lit(0)))
                                .otherwise(F.array(s))))
    return F.when(text.rlike(rf"\S{{{LONG + 1}}}"), cut).otherwise(words)


def _entry(part: str) -> str:
    """SQL: lane and summand of a part, packed."""
    low = f"(h & {(1 << LEVELS - 1) - 1}L)"
    level = f"cast(least(bit_count(({low} & -{low}) - 1L), {LEVELS - 1}) as bigint)"
    return (f"element_at(transform(array(xxhash64({part})), h -> shiftleft({level}, {LEVEL_SHIFT}) | "
            f"shiftleft(shiftrightunsigned(h, {LEVELS - 1}) & {LANES - 1}L, {SUM_BITS}) | "
            f"shiftleft(shiftrightunsigned(h, {LEVELS + 9}) & {(1 << HASH_BITS) - 1}L, {COUNT_BITS}) | 1L), 1)")


def with_vector(df: DataFrame, text_col: str, whole: str, lanes: str) -> DataFrame:
    """Add the two parts of the vector of ``text_col``: arrays of longs."""
    kept = df.columns
    text = text_of(text_col)
    out = df.withColumn("_paras", F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""))
    dense = ", ".join(f"aggregate(_paras, 0L, (a, p) -> (a + (xxhash64(p, {j}) & {WHOLE_MASK}L)) & {WHOLE_MASK}L)"
                      for j in range(WHOLE_LANES))
    out = out.select(*kept, F.expr(f"array({dense})").alias(whole), _parts(F.col("_paras"), text).alias("_parts"))
    # each of these columns is used more than once by the next step, which keeps Spark from computing it again
    out = out.select(*kept, whole, F.expr(f"sort_array(transform(_parts, s -> {_entry('s')}))").alias("_a"))
    out = out.select(*kept, whole, "_a", F.expr(f"""if(size(_a) = 0, cast(array() as array<int>), filter(sequence(0, size(_a) - 1),
        i -> i = size(_a) - 1 or shiftright(_a[i], {SUM_BITS}) <> shiftright(_a[i + 1], {SUM_BITS})))""").alias("_e"))
    start = "if(i = 0, 0, _e[i - 1] + 1)"
    return out.select(*kept, whole, F.expr(f"""transform(_e, (e, i) -> if(e = {start}, _a[e],
        (_a[e] & ~{SUM_MASK}L) | aggregate(slice(_a, {start} + 1, e - {start} + 1), 0L, (s, x) -> (s + (x & {SUM_MASK}L)) & {SUM_MASK}L)))
        """).alias(lanes))


def combine(whole_a: Column, lanes_a: Column, whole_b: Column, lanes_b: Column, sign: int = 1) -> tuple[Column, Column]:
    """Vector of the union (``sign=1``) or of ``a`` without ``b``'s paragraphs (``sign=-1``)."""
    whole = F.zip_with(whole_a, whole_b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(WHOLE_MASK)))
    lane = lambda x: x.bitwiseAND(F.lit(~SUM_MASK))
    keys = F.sort_array(F.array_union(F.transform(lanes_a, lane), F.transform(lanes_b, lane)))

    def at(lanes: Column, k: Column) -> Column:
        return F.aggregate(F.filter(lanes, lambda x: lane(x) == k), F.lit(0).cast("bigint"), lambda a, x: a + x.bitwiseAND(F.lit(SUM_MASK)))

    summed = F.transform(keys, lambda k: k.bitwiseOR((at(lanes_a, k) + F.lit(sign) * at(lanes_b, k)).bitwiseAND(F.lit(SUM_MASK))))
    return whole, F.filter(summed, lambda x: x.bitwiseAND(F.lit(SUM_MASK)) != 0)


def fingerprint(whole: str, lanes: str) -> Column:
    """Text form: the dense lanes, then the packed lanes in use, as decimal numbers."""
    return F.expr(f"concat_ws('.', cast({whole} as array<string>), cast({lanes} as array<string>))")


def _open_level(lanes: str) -> str:
    """SQL: the first level with at most ``CROWDED`` lanes in use (lanes come by level)."""
    return f"""if(size({lanes}) <= {CROWDED}, 0L, aggregate({lanes}, struct(0L as v, 0 as n),
        (acc, x) -> if(shiftright(x, {LEVEL_SHIFT}) = acc.v, struct(acc.v as v, acc.n + 1 as n),
            if(acc.n > {CROWDED} and shiftright(x, {LEVEL_SHIFT}) = acc.v + 1, struct(acc.v + 1 as v, 1 as n), acc)),
        acc -> least(if(acc.n > {CROWDED}, acc.v + 1, acc.v), {LEVELS - 1}L)))"""


def _alike(lanes_a: str, lanes_b: str, level: str) -> str:
    """SQL: parts in common over the parts of both, with their counts, from ``level`` on."""
    rows = " , ".join(f"filter({x}, x -> x >= shiftleft({level}, {LEVEL_SHIFT}))" for x in (lanes_a, lanes_b))
    count, hashed = f"& {(1 << COUNT_BITS) - 1}L", f"& {(1 << HASH_BITS) - 1}L"
    # entries of one lane follow each other; with one and the same part in both, the hashes' sums are in the ratio of the counts
    same = (f"shiftright(x, {SUM_BITS}) = shiftright(acc.x, {SUM_BITS}) and "
            f"((shiftright(x, {COUNT_BITS}) * (acc.x {count})) {hashed}) = ((shiftright(acc.x, {COUNT_BITS}) * (x {count})) {hashed})")
    return f"""aggregate(sort_array(concat({rows})), struct(-1L as x, 0L as both, 0L as all),
        (acc, x) -> struct(x as x, if({same}, acc.both + least(acc.x {count}, x {count}), acc.both) as both, acc.all + (x {count}) as all),
        acc -> if(acc.all = 0, 0D, acc.both / cast(acc.all - acc.both as double)))"""


def likeness(whole_a: str, lanes_a: str, whole_b: str, lanes_b: str) -> Column:
    """0 to 1: share of the parts of either side that both have; 1 for equal vectors only."""
    level = f"greatest({_open_level(lanes_a)}, {_open_level(lanes_b)})"
    return F.expr(f"""if({whole_a} = {whole_b}, 1D,
        least(element_at(transform(array({level}), v -> {_alike(lanes_a, lanes_b, "v")}), 1), 0.999999D))""")


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` of the row with the next smaller id; after the smallest comes the largest.

    Ids are cut into at most ``RANGES`` ranges at approximate quantiles of all
    ids, so that an outlier doesn't matter; rows without an id likewise by the
    beginning of their first column.  The first row of each range also goes to
    the range before it, as its last row's successor; that table of at most
    twice ``RANGES`` rows is all that is broadcast.  Texts are shuffled once, and a
    range is only streamed through.  Rows of equal id follow each other by
    ``columns``; null ids come last.
    """
    first, has_id = F.col(columns[0]), F.col(id_col).isNotNull()
    head = F.rpad(F.hex(F.substring(F.encode(first, "utf-8"), 1, 6)), 12, "0")
    head = F.when(~has_id, F.conv(head, 16, 10).cast("bigint"))
    parts = min(RANGES - 1, max(1, df.count() // ROWS_PER_RANGE))
    share = [(i + 1) / (parts + 1) for i in range(parts)]
    cuts = df.agg(F.percentile_approx(id_col, share, 10 * RANGES), F.percentile_approx(head, share, 10 * RANGES)).first()  # two rows of RANGES numbers
    by_id, by_head = ([int(x) for x in dict.fromkeys(c or [])] for c in cuts)
    place = F.when(has_id, _cell(F.col(id_col), by_id)).otherwise(-1 - _cell(head, by_head))
    rows = df.withColumn("_r", place)
    tops = rows.groupBy("_r").agg(F.max(id_col).alias("top"), F.xxhash64(F.min(F.when(~has_id, first))).alias("hash"))
    falling = Window.orderBy(F.desc("_r"))  # over at most twice RANGES rows
    around = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_last = F.lead(F.lit(1)).over(falling).isNull()
    before = F.broadcast(tops.select(F.col("_r").alias("_before"), *[
        F.when(is_last, F.first(c).over(around)).otherwise(F.lead(c).over(falling)).alias(f"_{c}") for c in ("top", "hash")]))
    extra = rows.join(before, F.col(id_col).eqNullSafe(F.col("_top")) & (has_id | (F.xxhash64(first) == F.col("_hash"))), "left")
    both = extra.withColumn("_r", F.explode(F.when(F.col("_before").isNull(), F.array("_r"))
                                            .otherwise(F.array(F.col("_r"), F.lit(None).cast("bigint")))))
    both = both.withColumn("_guest", F.col("_r").isNull()).withColumn("_r", F.coalesce("_r", "_before"))
    order = Window.partitionBy("_r").orderBy("_guest", F.col(id_col).desc_nulls_last(), *columns)
    lined = both.select(*df.columns, "_guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return lined.where("not _guest").drop("_guest")


def _cell(value: Column, cuts: list[int], step: int = 64) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``; looked up in two steps."""
    def below(numbers: Column) -> Column:
        return F.size(F.filter(numbers, lambda c: c <= value)).cast("bigint")

    def of(numbers: list[int]) -> Column:
        return F.lit(numbers).cast("array<bigint>") if numbers else F.array().cast("array<bigint>")
    coarse = below(of(cuts[step - 1::step])) * step
    return coarse + below(F.slice(of(cuts), (coarse + 1).cast("int"), F.lit(step)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's comparison of each text with its edited form and with the next text."""
    base = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    base = with_vector(base, "text", "whole", "lanes")
    both = with_next(base, id_col, ["text", "whole", "lanes"]).withColumn("n_chars", F.char_length("text").cast("bigint"))
    k = F.expr("cast(n_chars div 3 as int)")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k),
                                              F.substring("next_text", F.lit(1), k))).drop("text", "next_text")
    both = with_vector(both, "edited", "e_whole", "e_lanes")
    return both.select(
        F.col(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("whole", "lanes").alias("fingerprint"), fingerprint("e_whole", "e_lanes").alias("edited_fingerprint"),
        likeness("whole", "lanes", "e_whole", "e_lanes").alias("near_edited"),
        likeness("whole", "lanes", "next_whole", "next_lanes").alias("near_next"))
