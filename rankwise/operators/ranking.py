"""Exact, distributed row numbering and running counts within groups.

``row_number().over(Window.partitionBy(g))`` sends every row of a group to one
task, which fails when one job holds a third of all candidates.  Here a large
group is cut into cells at quantiles of its order:

1. one row in ``SAMPLE``, chosen by the hash of its order keys, goes into the
   table of bounds.  A group's sampled keys are sorted and thinned by dealt
   parts, and every ``PER_CELL``-th of them becomes a bound.  Each row of the
   group meets its bounds, so beyond ``FEW`` of them cells grow instead, up to
   ``FULL_CELL`` sampled rows, which a task still sorts with ease; only then
   bounds are added again (``MOST`` at most).  A small group has none;
2. a row's cell is the number of bounds before it, searched by halves.  Bounds
   are whole tuples of order keys, so neither an outlier nor a pile of ties in
   the leading keys fills a cell, whatever the keys' types are;
3. the rows of each cell are counted, and a running sum over the cells' counts
   goes with the bounds to the rows.  That table has the ``GROUPS`` largest groups
   (the next one holds less than that part of the rows, and stays whole), so
   it is broadcast: rows move once, to their cell, where they are numbered.

Which rows are sampled depends on their keys alone, so every branch of a plan
sees the same cells.  No size guard, no checkpoint, no value on the driver.
Null keys form groups of their own.  The order keys must form a total order and
be deterministic (sums of doubles should be rounded or summed as decimals
first); callers end them with a unique id.  Keys are column names or
expressions, ascending unless wrapped in ``desc``; nulls come first ascending
and last descending.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One row in so many is sampled; sampled rows of a cell; bounds of a group at most.
SAMPLE, PER_CELL, MOST = 1024, 8, 4095
#: Bounds from which on cells grow, and sampled rows of a cell that has grown (two million rows).
FEW, FULL_CELL = 63, 2048
#: Parts that a group's sampled rows are dealt into, and keys that each part passes on.
PARTS, PART_KEYS = 64, 512
#: Groups that are cut at most.
GROUPS = 4096


class Key(NamedTuple):
    expr: Column
    descending: bool
    name: str | None = None


def desc(key: str | Column) -> Key:
    return Key(F.col(key), True, key) if isinstance(key, str) else Key(key, True)


def asc(key: str | Column) -> Key:
    return Key(F.col(key), False, key) if isinstance(key, str) else Key(key, False)


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str) -> DataFrame:
    cond = None
    for a, b in pairs:
        eq = left[a].eqNullSafe(right[b])
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, how).drop(*[b for _, b in pairs])


def _before(x: Column, y: Column, keys: list[Key]) -> Column:
    """Whether the tuple of keys ``x`` comes before ``y``."""
    out = F.lit(False)
    for i, k in reversed(list(enumerate(keys))):
        a, b = x[f"_rk_o{i}"], y[f"_rk_o{i}"]
        if k.descending:
            less = F.coalesce(a > b, a.isNotNull() & b.isNull())
        else:
            less = F.coalesce(a < b, a.isNull() & b.isNotNull())
        out = less | (a.eqNullSafe(b) & out)
    return out


def _bounds(rows: DataFrame, groups: list[str], keys: list[Key]) -> DataFrame:
    """``_rk_bounds`` of the groups that are cut, and ``_rk_rows``, their sampled rows."""
    names = [f"_rk_o{i}" for i in range(len(keys))]

    def in_order(tuples: Column) -> Column:
        return F.array_sort(tuples, lambda x, y: F.when(_before(x, y, keys), -1).when(_before(y, x, keys), 1).otherwise(0))

    picked = rows.where(F.pmod(F.xxhash64(F.lit(5), *names), F.lit(SAMPLE)) == 0)
    part = F.pmod(F.xxhash64(F.lit(6), *names), F.lit(PARTS)).alias("_rk_part")
    dealt = picked.groupBy(*groups, part).agg(in_order(F.collect_list(F.struct(*names))).alias("_rk_t"))
    n = F.size("_rk_t")
    every = F.ceil(n / PART_KEYS)
    dealt = dealt.select(*groups, n.alias("_rk_n"), F.filter("_rk_t", lambda x, i: i % every == 0).alias("_rk_t"))
    whole = dealt.groupBy(*groups).agg(F.flatten(F.collect_list("_rk_t")).alias("_rk_t"), F.sum("_rk_n").alias("_rk_n")).withColumn("_rk_rows", F.col("_rk_n"))
    n = F.greatest(F.least(F.lit(FEW), F.floor(F.col("_rk_n") / PER_CELL)), F.floor(F.col("_rk_n") / FULL_CELL))
    whole = whole.withColumn("_rk_n", F.least(F.lit(MOST), n).cast("int")).where("_rk_n > 0")
    whole = whole.withColumn("_rk_t", in_order(F.col("_rk_t")))
    at = lambda j: F.get("_rk_t", F.floor(j * F.size("_rk_t") / (F.col("_rk_n") + 1)).cast("int"))
    return whole.select(*groups, "_rk_rows", F.transform(F.sequence(F.lit(1), F.col("_rk_n")), at).alias("_rk_bounds"))


def _cell(keys: list[Key]) -> Column:
    """Number of bounds before the row."""
    row = F.struct(*[k.expr.alias(f"_rk_o{i}") for i, k in enumerate(keys)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MOST.bit_length()))])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= F.size("_rk_bounds")) & _before(F.get("_rk_bounds", at + by - 1), row, keys), at + by).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def _in_cells(df: DataFrame, by: list[str], keys: list[Key], value: Column | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with group columns, the cell (0 in a group that isn't cut) and ``_rk_off``, the sum of ``value`` (or the count)
    over the group's cells before it; names of group and cell columns."""
    groups = by or ["_rk_all"]
    if not by:
        # always 0, but no constant: a join by a constant would become a nested loop
        df = df.withColumn("_rk_all", F.pmod(F.xxhash64(keys[0].expr), F.lit(1)).cast("int"))
    keyed = df.select(*groups, *[k.expr.alias(f"_rk_o{i}") for i, k in enumerate(keys)])
    bounds = _bounds(keyed, groups, keys)
    size = F.size("_rk_bounds")
    bounds = bounds.orderBy(F.desc("_rk_rows"), *groups).limit(GROUPS).drop("_rk_rows").withColumnsRenamed({g: f"_rk_b{j}" for j, g in enumerate(groups)})
    pairs = [(g, f"_rk_b{j}") for j, g in enumerate(groups)]
    valued = df.withColumn("_rk_v", F.lit(1).cast("bigint") if value is None else value)
    counted = _null_safe(valued, F.broadcast(bounds), pairs, "inner").withColumn("_rk_cell", _cell(keys))
    counted = counted.groupBy(*groups, "_rk_cell").agg(F.sum("_rk_v").alias("_rk_n"))
    counted = counted.groupBy(*[F.col(g).alias(f"_rk_c{j}") for j, g in enumerate(groups)]).agg(F.collect_list(F.struct("_rk_cell", "_rk_n")).alias("_rk_n"))
    table = _null_safe(bounds, counted, [(b, f"_rk_c{j}") for j, (_, b) in enumerate(pairs)], "left")
    before = lambda c: F.aggregate(F.filter("_rk_n", lambda x: x["_rk_cell"] < c), F.lit(0).cast("bigint"), lambda acc, x: acc + x["_rk_n"])
    table = table.select(*[b for _, b in pairs], "_rk_bounds", F.transform(F.sequence(F.lit(0), size), before).alias("_rk_offs"))
    rows = _null_safe(df, F.broadcast(table), pairs, "left")
    rows = rows.withColumn("_rk_cell", F.when(F.col("_rk_bounds").isNull(), 0).otherwise(_cell(keys)))
    rows = rows.withColumn("_rk_off", F.coalesce(F.get("_rk_offs", F.col("_rk_cell")), F.lit(0).cast("bigint")))
    return rows.drop("_rk_bounds", "_rk_offs"), groups, ["_rk_cell"]


def _running(df: DataFrame, by: Sequence[str], order: Sequence, value: Column | None, name: str) -> DataFrame:
    """Sum of ``value`` (or the count) over the rows before each row, per group."""
    keys = [k if isinstance(k, Key) else asc(k) for k in order]
    own = {f"_rk_k{i}": k.expr for i, k in enumerate(keys) if k.name is None}
    keys = [k if k.name else Key(F.col(f"_rk_k{i}"), k.descending) for i, k in enumerate(keys)]
    value = None if value is None else value.cast("bigint")
    rows, groups, cells = _in_cells(df.withColumns(own) if own else df, list(by), keys, value)
    inside = Window.partitionBy(*groups, *cells).orderBy(*[k.expr.desc() if k.descending else k.expr.asc() for k in keys])
    before = F.row_number().over(inside) - 1 if value is None else F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_rk_in", before.cast("bigint"))
    return rows.select(*df.columns, (F.col("_rk_off") + F.col("_rk_in")).alias(name))


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "place") -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its ``by`` group (bigint)."""
    return _running(df, by, order, None, name).withColumn(name, F.col(name) + 1)


def prefix_count(df: DataFrame, by: Sequence[str], order: Sequence, flag: Column, name: str) -> DataFrame:
    """Number of earlier rows (strictly before, in ``order``) of the same ``by`` group whose ``flag`` is true."""
    return _running(df, by, order, F.coalesce(flag.cast("bigint"), F.lit(0)), name)
