"""Ranked lexical search by pipelined term partitioning.

Documents are dealt into shards, items (the queries) into bundles, and terms to
owners by how common they are, the rarest first.  For every bundle and shard
one row travels through the owners' stages in turn, joined to the owner's
postings by ``cogroup``: it carries, for each item, the documents scored so
far and their integer sums, and each stage adds what its terms contribute.

An accumulator is dropped as soon as it is certain that it can't be among the
``top`` of its item: its sum plus the most that the remaining owners can add in
this shard is below the ``top``-th largest sum reached there.  Sums only grow,
so the result is exact.  The last stage passes on the ``top`` of the shard, and
the best over all shards are selected with a limit before the shuffle.

Only terms that some item has matter.  They are recognised by a bitmap of
fixed size (``BITMAP_BITS``, 512 kB); a false hit is dropped when postings are
cut to a bundle's terms.  Terms are told apart by 64-bit hashes.

Memory: a shard has about ``SHARD_DOCS`` documents and a bundle ``BUNDLE``
items, so that accumulators of a task are bounded; a task that builds postings
holds the terms of ``WAVE`` bundles.  Rows are dealt to shards in turn, so
copies and hot words spread evenly; the deal is written before it is used.

Defined results: null and empty texts have no terms, such documents don't
count and such items find nothing; equal rows of ``items`` are one item, rows
of one ``item_id`` with other texts get lists of their own; repeated documents
are documents of their own; a null ``doc_id`` comes after the others of its score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwise.llm import rolling as ro
from rankwise.llm.common import stored, text_slices

U = np.uint64
TOP = 20
SHARD_DOCS = 1 << 14
BUNDLE = 256
WAVE = 64
BITMAP_BITS = 1 << 22
#: An owner takes the terms that at most this share of the documents holds (and no earlier owner takes).
OWNERS = (1 / 256, 1 / 32, 1 / 6, 1.0)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[97:123] = _BREAKS[128:] = False


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and text number of every term."""
    data = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    buf = _LOWER[np.frombuffer(b" ".join(data), np.uint8)].tobytes()
    h, start, _ = ro.words(buf, _BREAKS)
    return h, np.searchsorted(np.cumsum([len(d) + 1 for d in data]), start, "right"), len(data)


def _counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) and how often."""
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate((at, [len(h)])))


def _position(h: np.ndarray) -> np.ndarray:
    return (h >> U(20)) & U(BITMAP_BITS - 1)


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, term, qf``; ``item`` is a hash of the item's row."""
    def split(batches):
        for b in text_slices(batches, 1):
            h, doc, _ = _terms(b.column(1).to_pylist())
            doc, h, n = _counted(h, doc)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())],
                                             names=["item", "term", "qf"])
    return items.select("item", "text").mapInArrow(split, "item bigint, term bigint, qf bigint")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which hash positions the items use; at most ``BITMAP_BITS`` bits reach the driver."""
    at = F.shiftrightunsigned("term", 20).bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1  # buckets begin at position 1
    parts = (terms.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    out = np.zeros(BITMAP_BITS, bool)
    for r in parts:
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.part - 1) * len(bits) + np.flatnonzero(bits)] = True
    return out


def _indexed(docs: DataFrame, wanted: np.ndarray, shards: int) -> DataFrame:
    """Documents with a term: ``doc_id, shard, n`` and the packed terms that items may ask for."""
    bits = np.packbits(wanted)

    def index(batches):
        known = np.unpackbits(bits).astype(bool)
        turn = (TaskContext.get().partitionId() * 7919) % shards
        for b in text_slices(batches, 1):
            h, doc, rows = _terms(b.column(1).to_pylist())
            n = np.bincount(doc, minlength=rows)
            hit = known[_position(h)]
            d, h, tf = _counted(h[hit], doc[hit])
            cut = np.searchsorted(d, np.arange(rows + 1))
            full = np.flatnonzero(n)
            shard = (turn + np.arange(len(full))) % shards
            turn = (turn + len(full)) % shards
            tf = tf.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(full)), pa.array(shard, pa.int32()), pa.array(n[full], pa.int64()),
                 pa.array([h[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary()),
                 pa.array([tf[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary())],
                names=["doc_id", "shard", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        index, "doc_id bigint, shard int, n bigint, terms binary, tfs binary")


def _document_frequency(index: DataFrame) -> DataFrame:
    def count(batches):
        for b in text_slices(batches, 0):
            h, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["term", "df"])
    return index.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _pack(parts: list[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(p).tobytes() for p in parts]


_QUERY = ("<i8", "<u4", "<i8", "<i8", "u1")  # items; of each term of an item: item, term, weight, owner


def _bundles(weighted: DataFrame) -> DataFrame:
    """One row per bundle: its items and their weighted terms, packed."""
    def pack(t: pa.Table) -> pa.Table:
        items, slot = np.unique(t["item"].to_numpy(), return_inverse=True)
        term, weight, owner = (t[c].to_numpy() for c in ("term", "weight", "owner"))
        o = np.lexsort((slot, term))
        parts = _pack([items.astype("<i8"), slot[o].astype("<u4"), term[o], weight[o], owner[o].astype("u1")])
        return pa.table({"bundle": t["bundle"][:1], "query": pa.array([parts], pa.list_(pa.binary()))})
    return weighted.groupBy("bundle").applyInArrow(pack, "bundle int, query array<binary>")


def _impacts(tf: np.ndarray, n: np.ndarray, of: np.ndarray, total: int, length: int) -> np.ndarray:
    m = np.array([75 + (25 * int(x) * total) // length for x in n], np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])


def _postings(total: int, length: int, owners: int):
    """Cogroup step: a shard's documents and a wave's bundles -> a bundle's first row and its postings by owner."""
    def build(key, docs: pa.Table, bundles: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and bundles.num_rows:
            docs = docs.sort_by([("doc_id", "ascending")])  # nulls last
            n, terms = docs["n"].to_numpy(), [np.frombuffer(x, "<i8") for x in docs["terms"].to_pylist()]
            of = np.repeat(np.arange(len(n), dtype=np.uint32), [len(x) for x in terms])
            impact = _impacts(np.frombuffer(b"".join(docs["tfs"].to_pylist()), "<u4"), n, of, total, length)
            term = np.concatenate(terms)
            o = np.argsort(term, kind="stable")
            term, of, impact = term[o], of[o], impact[o].astype("<u4")
            first, last = ro.runs(term)
            have, size = term[first], last - first + 1
            most = np.maximum.reduceat(impact, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
            ids = docs["doc_id"]
            known = len(ids) - ids.null_count
            ids = ids.slice(0, known).to_numpy().astype("<i8")
            shard = int(key[0].as_py())
            for bundle, query in zip(bundles["bundle"].to_pylist(), bundles["query"].to_pylist(), strict=True):
                items, slot, q_term, weight, owner = (np.frombuffer(p, k) for p, k in zip(query, _QUERY, strict=True))
                at = np.searchsorted(have, q_term)
                at[at == len(have)] = 0
                found = have[at] == q_term if len(have) else np.zeros(len(q_term), bool)
                at, slot, q_term, weight, owner = at[found], slot[found], q_term[found], weight[found], owner[found]
                bound = np.zeros((len(items), owners), np.int64)
                np.add.at(bound, (slot, owner), weight * most[at])
                rows.append((bundle, shard, -1, _pack([
                    np.array([len(n), known], "<i8"), ids, items, slot, q_term, weight, owner, bound, np.zeros(len(items), "<i8"),
                    np.zeros(len(items) + 1, "<i8"), np.zeros(0, "<u4"), np.zeros(0, "<i8")])))
                for k in range(owners):
                    mine = np.unique(at[owner == k])
                    if len(mine):
                        pick = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(size[mine])[:-1])), size[mine]) + np.arange(size[mine].sum())
                        rows.append((bundle, shard, k, _pack([have[mine], size[mine].astype("<i8"), of[pick], impact[pick]])))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table({"bundle": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()),
                         "owner": pa.array(cols[2], pa.int32()), "parts": pa.array(cols[3], pa.list_(pa.binary()))})
    return build


_STATE = ("<i8", "<i8", "<i8", "<u4", "<i8", "<i8", "u1", "<i8", "<i8", "<i8", "<u4", "<i8")


def _add(state: pa.Table, postings: pa.Table, owner: int, owners: int, top: int):
    """The bundle's row with the owner's contributions: its parts, and per item the documents and sums kept."""
    head, ids, items, slot, q_term, weight, q_owner, bound, floor, ptr, doc, score = (
        np.frombuffer(p, k) for p, k in zip(state["parts"][0].as_py(), _STATE, strict=True))
    n = int(head[0])
    bound, floor = bound.reshape(len(items), owners), floor.copy()
    if postings.num_rows:
        have, size, of, impact = (np.frombuffer(p, k) for p, k in zip(postings["parts"][0].as_py(), ("<i8", "<i8", "<u4", "<u4"), strict=True))
        begin = np.concatenate(([0], np.cumsum(size)))
        impact = impact.astype(np.int64)
    mine = np.flatnonzero(q_owner == owner)
    mine = mine[np.argsort(slot[mine], kind="stable")]
    cut = np.searchsorted(slot[mine], np.arange(len(items) + 1))
    kept = []
    for i in range(len(items)):
        a, b = ptr[i], ptr[i + 1]
        if cut[i] == cut[i + 1] and a == b:
            kept.append((doc[:0], score[:0]))
            continue
        dense = np.zeros(n, np.int64)
        dense[doc[a:b]] = score[a:b]
        for q in mine[cut[i]:cut[i + 1]]:
            t = int(np.searchsorted(have, q_term[q]))
            s = slice(begin[t], begin[t + 1])
            dense[of[s]] += weight[q] * impact[s]
        at = np.flatnonzero(dense)
        sums = dense[at]
        if len(at) >= top:
            floor[i] = max(floor[i], np.partition(sums, len(sums) - top)[len(sums) - top])
        keep = sums + bound[i, owner + 1:].sum() >= floor[i]
        kept.append((at[keep].astype("<u4"), sums[keep]))
    later = q_owner > owner
    parts = [head, ids, items, slot[later], q_term[later], weight[later], q_owner[later], bound, floor]
    return parts, kept


def _stage(owner: int, owners: int, top: int):
    """Cogroup step of one owner: the bundles' rows and the owner's postings -> the bundles' rows."""
    def add(key, state: pa.Table, postings: pa.Table) -> pa.Table:
        if not state.num_rows:
            return pa.table({"bundle": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "parts": pa.array([], pa.list_(pa.binary()))})
        parts, kept = _add(state, postings, owner, owners, top)
        ptr = np.concatenate(([0], np.cumsum([len(d) for d, _ in kept]))).astype("<i8")
        packed = _pack([*parts, ptr, np.concatenate([d for d, _ in kept]).astype("<u4"), np.concatenate([s for _, s in kept])])
        return pa.table({"bundle": state["bundle"], "shard": state["shard"], "parts": pa.array([packed], pa.list_(pa.binary()))})
    return add


def _last(owner: int, owners: int, top: int):
    """Cogroup step of the last owner: the best of the shard."""
    def select(key, state: pa.Table, postings: pa.Table) -> pa.Table:
        out = []
        if state.num_rows:
            (head, ids, items, *_), kept = _add(state, postings, owner, owners, top)
            for item, (d, s) in zip(items.tolist(), kept, strict=True):
                o = np.lexsort((d, -s))[:top]  # documents are numbered by doc_id
                out += [(item, int(ids[i]) if i < head[1] else None, x) for i, x in zip(d[o].tolist(), s[o].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "doc_id", "score"), cols, strict=True)})
    return select


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, shard_docs: int = SHARD_DOCS, bundle: int = BUNDLE,
           wave: int = WAVE, shares: tuple[float, ...] = OWNERS) -> DataFrame:
    """``docs`` (``doc_id, text``), ``items`` (``item_id, text``) -> ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    terms = stored(_item_terms(items))
    wanted = _bitmap(terms)
    shards = max(1, -(-docs.count() // shard_docs))
    index = stored(_indexed(docs, wanted, shards))
    total, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id bigint, score bigint")
    n_bundles = max(1, -(-terms.select("item").distinct().count() // bundle))
    waves = -(-n_bundles // wave)
    df = F.col("df")
    owner = F.lit(len(shares) - 1)
    for k in reversed(range(len(shares) - 1)):
        owner = F.when(df <= int(shares[k] * total), k).otherwise(owner)
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2) * total + 2) / (2 * df + 1)))
    weighted = (terms.join(_document_frequency(index), "term")
                .select(F.pmod("item", F.lit(n_bundles)).cast("int").alias("bundle"), "item", "term",
                        (F.col("qf") * weight).cast("bigint").alias("weight"), owner.cast("int").alias("owner")).where("weight > 0"))
    query = _bundles(weighted).withColumn("wave", (F.col("bundle") % waves).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    built = stored(dealt.groupBy("shard", "wave").cogroup(query.groupBy("shard", "wave")).applyInArrow(
        _postings(total, length, len(shares)), "bundle int, shard int, owner int, parts array<binary>"))
    state = built.where("owner = -1").drop("owner")
    for k in range(len(shares)):
        # columns of their own: both sides are cut from one table
        postings = built.where(F.col("owner") == k).select(*[F.col(c).alias(c) for c in ("bundle", "shard", "parts")])
        pair = state.groupBy("bundle", "shard").cogroup(postings.groupBy("bundle", "shard"))
        if k < len(shares) - 1:
            state = pair.applyInArrow(_stage(k, len(shares), top), "bundle int, shard int, parts array<binary>")
        else:
            found = pair.applyInArrow(_last(k, len(shares), top), "item bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return items.select("item", "item_id").join(found, "item").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH term_rows AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tokens AS (
  SELECT kind, r, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM term_rows),
counted AS (SELECT kind, r, any_value(id) AS id, term, count(*) AS tf FROM tokens GROUP BY kind, r, term),
doc AS (SELECT r, sum(tf)::BIGINT AS n FROM counted WHERE kind = 0 GROUP BY r),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, corpus WHERE kind = 0 GROUP BY term),
score AS (
  SELECT i.r AS item, any_value(i.id) AS item_id, d.r AS doc, any_value(d.id) AS doc_id,
         sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM counted i JOIN counted d ON i.kind = 1 AND d.kind = 0 AND i.term = d.term
  JOIN weight ON weight.term = d.term JOIN doc ON doc.r = d.r, corpus
  GROUP BY i.r, d.r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM score WHERE score > 0)
WHERE rank <= 20
"""
