"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot ``k`` of the mix has the golden-ratio point ``frac(k * 0.618...)``, on a
32-bit grid.  The point falls into one source's part of the cumulative target
weights.  Each source's slots are ranked in order of ``k``; slot rank ``r``
takes block ``r`` of the source's shuffled token stream, which is the source
twice over (two epochs, each in its own order), cut into blocks of an equal
number of words.  Any stretch of the schedule therefore holds the sources
near their weights.

Scale: no source is ever gathered.  Ranks and stream offsets are running sums
over ranges of a few thousand rows plus a running sum over the ranges.
Only a count and two sums reach the driver.

Defined results: a null text has no words; a document without words takes
nothing; a null source is a source and comes last; equal rows are separate
documents.  Reruns give the same mix (hashes of ``doc_id`` and text order the
stream).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwise.llm.common import SPACE_CLASS, stored, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 64
#: 2^32 divided by the golden ratio.
GOLDEN = 2654435769
GRID = 1 << 32
#: Rows over which one running sum goes, on average.
RANGE_ROWS = 4096
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            limit: float = EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> with ``target``, ``cum_lo``, ``cum_hi``.

    Filling in order of ``limit * size / weight``: a source is full when its
    limit is below its weight's share of what the sources before it leave.
    One row per source is all that these windows see.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("n") % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("n", F.row_number().over(by_name) - 1).withColumn("w", w)
              .withColumn("cap", F.col("source_size") * float(limit)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "n")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    ranked = ranked.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    ranked = ranked.withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    first_open = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "n", "level"))).over(Window.partitionBy())
    ranked = ranked.withColumn("level", first_open["level"]).withColumn(
        "target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("level")))
    hi = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    sum_all = F.sum("target").over(Window.partitionBy())
    return ranked.select("source", "source_size", "target", (hi - F.col("target")).alias("lo"), hi.alias("hi"),
                         sum_all.alias("sum_all")).select(
        "source", "source_size", "target", F.when(F.col("sum_all") > 0, F.col("lo") / F.col("sum_all")).alias("cum_lo"),
        F.when(F.col("sum_all") > 0, F.col("hi") / F.col("sum_all")).alias("cum_hi"))


def schedule(spark, aims: DataFrame, words: float, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots ``(slot, source, rank)`` for ``words`` words of the mix."""
    n = int(-(-words // block_words))
    slots = spark.range(n).select(
        F.col("id").alias("slot"),
        (F.expr(f"((id % {1 << 31}L) * {GOLDEN}L) % {GRID}L") / float(GRID)).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    parts = aims.where("cum_hi > cum_lo").select(
        "source", "cum_lo", F.when(F.col("cum_hi") > 1 - 1e-12, F.lit(2.0)).otherwise(F.col("cum_hi")).alias("cum_hi"),
        F.explode(F.sequence(F.floor(F.col("cum_lo") * CELLS),
                             F.least(F.floor(F.col("cum_hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    got = slots.join(parts, "cell").where("point >= cum_lo and point < cum_hi").select("slot", "source")
    got = got.withColumn("chunk", F.expr(f"slot div {RANGE_ROWS}"))
    counts = got.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    starts = counts.select(
        F.col("source").alias("s"), F.col("chunk").alias("k"),
        (F.sum("c").over(Window.partitionBy("source").orderBy("chunk")) - F.col("c")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("chunk", "source").orderBy("slot")) - 1
    return (got.withColumn("inside", inside).join(starts, (F.col("chunk") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")))
            .select("slot", "source", (F.col("start") + F.col("inside")).alias("rank")))


def streams(rows: DataFrame, n: int) -> DataFrame:
    """Rows ``(doc_id, uid, source, size)`` -> one row per epoch with its ``offset`` in the source's stream."""
    ranges = max(1, n // RANGE_ROWS)
    out = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
    out = out.withColumn("order", F.xxhash64("epoch", "uid", "doc_id")).withColumn(
        "range", F.floor((F.col("order") / float(1 << 64) + 0.5) * ranges))
    sums = out.groupBy("source", "epoch", "range").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("epoch", "range")
    starts = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("range").alias("g"),
                         (F.sum("words").over(run) - F.col("words")).alias("start"))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("order", "doc_id", "uid").rowsBetween(
        Window.unboundedPreceding, 0)
    out = out.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return (out.join(starts, (F.col("range") == F.col("g")) & (F.col("epoch") == F.col("e"))
                     & F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "uid", "source", "size", "epoch", (F.col("start") + F.col("inside")).alias("offset")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(takes, aims)``.

    ``takes``: for each row and epoch ``doc_id, uid, source, size, epoch,
    offset, taken``; the words taken of an epoch are the document's first
    ``taken`` words.  ``uid`` is ``row_uid`` of the row.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), row_uid(id_col, text_col, source_col).alias("uid"),
                              F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size")))
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    lined = stored(streams(rows, n))
    pieces = lined.where("size > 0").select(
        "source", "epoch", "offset", "size",
        F.explode(F.sequence(F.expr(f"offset div {block_words}"), F.expr(f"(offset + size - 1) div {block_words}"))).alias("rank"))
    pieces = pieces.withColumn("part", F.expr(
        f"least(offset + size, (rank + 1) * {block_words}) - greatest(offset, rank * {block_words})"))
    slots = schedule(docs.sparkSession, aims, words * share, block_words)
    got = (pieces.join(slots.select("rank", F.col("source").alias("s")).withColumnRenamed("rank", "k"),
                       (F.col("rank") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")))
           .groupBy(F.col("source").alias("ts"), F.col("offset").alias("to")).agg(F.sum("part").alias("got")))
    takes = lined.join(got, (F.col("offset") == F.col("to")) & F.col("source").eqNullSafe(F.col("ts")) & (F.col("size") > 0), "left")
    return takes.select(*lined.columns, F.coalesce("got", F.lit(0)).cast("bigint").alias("taken")), aims


def row_uid(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col).cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    takes, aims = mix(docs)
    # the two epochs of a row meet through their own order number, as equal rows are separate documents
    nth = F.row_number().over(Window.partitionBy("uid", "doc_id", "epoch").orderBy("offset"))
    rows = takes.withColumn("nth", nth).groupBy("uid", "doc_id", "source", "size", "nth").agg(
        F.sum("taken").alias("taken"))
    return rows.join(aims.select(F.col("source").alias("s"), "source_size", "target"),
                     F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row per epoch in which words are taken, its text cut after the last of them."""
    takes, _ = mix(docs)
    takes = takes.where("taken > 0").select(F.col("doc_id").alias("t_id"), "uid", F.col("size").alias("t_size"), "taken")
    texts = docs.withColumn("uid", row_uid("doc_id", "text", "source")).dropDuplicates(["uid", "doc_id"])
    both = texts.join(takes, (texts["uid"] == takes["uid"]) & texts["doc_id"].eqNullSafe(takes["t_id"]))
    cut = F.expr(f"array_join(slice(regexp_extract_all(text, '[^{SPACE_CLASS}]+[{SPACE_CLASS}]*', 0), 1, "
                 "cast(taken as int)), '')".replace("\\", "\\\\"))
    both = both.withColumn("text", F.when(F.col("taken") < F.col("t_size"), cut).otherwise(F.col("text")))
    return both.select("doc_id", "text", "lang", docs["source"], F.char_length("text").cast("bigint").alias("n_chars"))
