"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors.  A vector is
described by its nearest pivots in order of nearness: ``near`` of them, and one
more for each doubling of the pivots past ``NEAR_PIVOTS``, as near vectors have
fewer of them in common the more there are.  Each pivot has an inverted list of the vectors that name it; two vectors are retrieved for
each other if they name at least ``shared`` pivots in common, and linked if
their cosine, in double precision, reaches ``least``.

Two vectors with ``shared`` common pivots have one among the first
``near - shared + 1`` of each when the pivots are taken in one fixed order,
so a vector enters only those lists.  A pair is counted in the list of its
first common pivot, so no pair table has to be made distinct: a list
reports per vector how many vectors it links there and a star of each group.
Equal vectors are one entry with a count.  Lists that are too long for one
task are cut into blocks, and every pair of blocks is compared somewhere.

Defined results: a vector that is null, empty, zero, or holds null or
non-finite components links with nothing; vectors of different length don't
link; equal rows are separate vectors; a row without ``vec_id`` counts as a
neighbour, and its ``component_id`` is null if no row of its component has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwise.llm.common import salted_join, stored
from rankwise.llm.components import components
from rankwise.llm.simhash import stars

LEAST = 0.95
NEAR = 8
SHARED = 3
#: Pivots for which ``near`` are enough.
NEAR_PIVOTS = 1024
#: Pivots: one for this many distinct vectors, between the bounds (the upper one bounds the sample, which is sent to every task).
VECTORS_PER_PIVOT = 64
MIN_PIVOTS, MAX_PIVOTS = 16, 65_536
#: Vectors of a list that one task compares, all with all.
BLOCK = 2048
#: Bytes of nearness (8 for each vector and pivot) that a task works out at once.
NEARNESS_BYTES = 8 << 20


def _usable(v: str) -> F.Column:
    return F.expr(f"{v} is not null and size({v}) > 0 and not exists({v}, x -> x is null or isnan(x) or abs(x) = "
                  f"double('infinity')) and exists({v}, x -> x <> 0)")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def nearest(pivots: int, near: int = NEAR) -> int:
    """Pivots that describe a vector, out of so many."""
    return min(pivots, near + max(0, -(-pivots // NEAR_PIVOTS) - 1).bit_length())


def describe(vectors: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; equal nearness by pivot number."""
    near = min(near, len(pivots))
    step = max(1, NEARNESS_BYTES // (8 * max(1, len(pivots))))
    out = []
    for a in range(0, len(vectors), step):
        away = -np.round(vectors[a:a + step] @ pivots.T, 12)
        within = away <= np.partition(away, near - 1, axis=1)[:, near - 1:near]
        if (within.sum(axis=1) == near).all():
            at = np.nonzero(within)[1].reshape(-1, near)
            order = np.argsort(np.take_along_axis(away, at, axis=1), axis=1, kind="stable")
            out.append(np.take_along_axis(at, order, axis=1))
        else:  # pivots tie for the last place
            out.append(np.argsort(away, axis=1, kind="stable")[:, :near])
    return np.concatenate(out) if out else np.zeros((0, near), np.int64)


def _postings(pivots: np.ndarray, near: int, shared: int):
    def apply(batches):
        for b in batches:
            m = _matrix(b.column(1))
            perm = describe(m, pivots, near)
            rare = np.sort(perm, axis=1)[:, :max(1, perm.shape[1] - shared + 1)]  # in the fixed order of the pivots
            for k in range(rare.shape[1]):
                yield pa.RecordBatch.from_pydict({
                    "pivot": pa.array(rare[:, k].astype(np.int32)), "node": b.column(0), "embedding": b.column(1),
                    "copies": b.column(2), "perm": pa.array(list(perm.astype(np.int32)), pa.list_(pa.int32()))})
    return apply


def _compare(shared: int, least: float, near: int):
    def group(key, t):
        pivot, mine, other = (k.as_py() for k in key)
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        v = _matrix(t["embedding"])
        perm = np.sort(np.stack(t["perm"].to_numpy()), axis=1)
        block = t["block"].to_numpy()
        names = np.unique(perm)
        has = np.zeros((len(node), len(names)), np.float32)
        has[np.arange(len(node))[:, None], np.searchsorted(names, perm)] = 1
        weight = np.zeros(len(node), np.int64)
        left, right = [], []
        need = min(shared, perm.shape[1])
        first = perm[:, :max(1, perm.shape[1] - shared + 1)]
        for a in range(0, len(node), 512):
            common = has[a:a + 512] @ has.T >= need
            common &= np.arange(len(node))[None, :] > np.arange(a, min(a + 512, len(node)))[:, None]
            if mine != other:
                common &= block[a:a + 512, None] != block[None, :]
            i, j = np.nonzero(common)
            if not len(i):
                continue
            cos = (v[a:a + 512] @ v.T)[i, j]
            ok = cos >= least
            i, j = i[ok] + a, j[ok]
            # counted where the pivot is the first that both lists entries share
            same = (first[i][:, :, None] == first[j][:, None, :]).any(axis=2)
            owner = first[i, np.argmax(same, axis=1)] == pivot
            i, j = i[owner], j[owner]
            np.add.at(weight, i, copies[j])
            np.add.at(weight, j, copies[i])
            left.append(node[i])
            right.append(node[j])
        at = np.flatnonzero(weight)
        root = dict(zip(*(x.tolist() for x in stars(None, np.concatenate(left), np.concatenate(right))), strict=True)) if left else {}
        return pa.table({"node": pa.array(node[at], pa.int64()), "weight": pa.array(weight[at], pa.int64()),
                         "root": pa.array([root.get(int(x), int(x)) for x in node[at]], pa.int64())})
    return group


def dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST,
          near: int = NEAR, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # compared as doubles
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    usable = F.coalesce(_usable("v"), F.lit(False))
    ids = rows.select("vec_id", F.when(usable, F.xxhash64("v")).alias("node"), F.when(usable, F.xxhash64(F.lit(1), "v")).alias("mark"))
    classes = stored(rows.where(usable).groupBy(F.xxhash64("v").alias("node"), F.xxhash64(F.lit(1), "v").alias("mark"))
                     .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("v").alias("embedding")))
    sizes = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()  # vector lengths
    reports = None
    for d, n in sizes:
        mine = classes.where(F.size("embedding") == d).select("node", "embedding", "copies")
        count = min(MAX_PIVOTS, max(MIN_PIVOTS, n // VECTORS_PER_PIVOT))
        sample = mine.orderBy("node").limit(count).select("embedding").toArrow()
        pivots = _matrix(sample["embedding"])
        named_by = nearest(len(pivots), near)
        lists = stored(mine.mapInArrow(_postings(pivots, named_by, shared),
                                       f"pivot int, node bigint, embedding {kind}, copies bigint, perm array<int>"))
        # a row per pivot at most
        long = {r["pivot"]: -(-r["n"] // block) for r in
                lists.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()}
        blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in long.items() for x in kv]), F.col("pivot")),
                            F.lit(1)) if long else F.lit(1)
        placed = lists.withColumn("blocks", blocks).withColumn(
            "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "pivot", F.least("block", "with").alias("mine"), F.greatest("block", "with").alias("other"),
            "node", "embedding", "copies", "perm", "block")
        got = placed.groupBy("pivot", "mine", "other").applyInArrow(
            _compare(shared, least, named_by), "node bigint, weight bigint, root bigint")
        reports = got if reports is None else reports.union(got)
    if reports is None:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.col("vec_id").isNotNull().alias("kept"))
    reports = stored(reports)
    groups = components(reports.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "n"})
    counts = reports.groupBy(F.col("node").alias("c")).agg(F.sum("weight").alias("weight"))
    named = (classes.join(groups, F.col("node") == F.col("n"), "left").join(counts, F.col("node") == F.col("c"), "left")
             .select("node", "mark", "first_id", F.coalesce("component", "node").alias("component"),
                     (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("links")))
    names = named.groupBy(F.col("component").alias("k")).agg(F.min("first_id").alias("name"))
    named = named.join(names, F.col("component") == F.col("k")).select("node", "mark", "links", "name")
    out = salted_join(ids, named, ["node", "mark"], "vec_id", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("name"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup(vectors)


#: All pairs in DuckDB (every link, where the index may miss some).
ORACLE_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    and list_cosine_similarity(a.e, b.e) >= 0.95
),
reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, p.b from reach r join pairs p on p.a = r.b
),
names as (select a as vec_id, min(b) as component_id from reach group by a),
links as (select a as vec_id, count(*) as n from pairs group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from embeddings left join links using (vec_id) join names using (vec_id)
"""
